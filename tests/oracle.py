"""Compare registered queries with their SQL run by DuckDB on the same files."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, run, sql):
    df = run(spark, folder)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows {len(got[1])}", True
    result = con.execute(sql)
    want = table([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", False
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}", False
    bad = [(g, w) for g, w in zip(*(got[1], want[1])) if repr(g) != repr(w)]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, first\n     got {bad[0][0]}\n    want {bad[0][1]}", False
    return f"equal, {len(got[1])} rows", True


def main(argv):
    from gridlens.plans import ORACLES, QUERIES
    from gridlens.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(8), connect(folder)
    keys = [k for k in QUERIES if not argv or any(k == a or (a.endswith("*") and k.startswith(a[:-1])) for a in argv)]
    failed = []
    for key in keys:
        start = time.time()
        try:
            note, ok = compare(spark, con, folder, QUERIES[key], ORACLES.get(key))
        except Exception as error:  # report and go on with the next query
            note, ok = f"ERROR {type(error).__name__} {str(error)[:600]}", False
        if not ok:
            failed.append(key)
        print(f"{'ok  ' if ok else 'FAIL'} {key} {time.time() - start:.2f}s {note}", flush=True)
    print(f"{len(keys) - len(failed)} of {len(keys)} ok; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
