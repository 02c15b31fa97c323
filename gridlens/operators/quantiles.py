"""Exact quantiles (linear interpolation) without gathering a column in one task.

Short columns go to the built-in ``percentile`` aggregate, which keeps every distinct value in
one task. Past that, a mergeable quantile sketch brackets each wanted rank, exact counts
confirm the bracket, and the search repeats inside it until few values remain. Rows are
never shuffled: each round is one scan that returns one small row. Many wanted ranks would
make expressions too long to compile, so values then find their bracket in the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.scalar import col
from gridlens.operators import ordered
from gridlens.session import max_group_rows

_ACCURACY = 2000
#: Columns of up to this many values (together ten times as many) go to the built-in aggregate, which keeps every distinct value.
DIRECT = 100_000
#: The search ends when at most this many values can hold the wanted rank.
BRACKET = 20_000
#: More wanted ranks than this are sought in tasks, not by expressions.
TARGETS = 200


def agg_row(df: DataFrame, expressions: dict[str, Column], batch: int = 200) -> dict:
    """Whole-table aggregates as a dict; in batches so that generated code stays small."""
    names = list(expressions)
    out = {}
    for start in range(0, len(names), batch):
        part = names[start:start + batch]
        row = df.agg(*[expressions[n].alias(f"a{i}") for i, n in enumerate(part)]).first()
        out.update(dict(zip(part, row)))
    return out


def column_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], limit: int = DIRECT
) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns; nulls are ignored. The answer is k x m numbers."""
    numbers = df.select(*[col(c).cast("double").alias(f"q{i}") for i, c in enumerate(columns)])
    names = numbers.columns
    counts = agg_row(numbers, {n: F.count(n) for n in names})
    if max(counts.values()) <= limit and sum(counts.values()) <= 10 * limit:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        found = agg_row(numbers, {n: F.percentile(n, wanted) for n in names}, batch=50)
        return {c: (list(found[n]) if found[n] is not None else [None] * len(probs)) for c, n in zip(columns, names)}
    ranks = {}
    for n in names:
        for p in probs:
            place = (counts[n] - 1) * p
            if counts[n]:
                ranks.setdefault((n, math.floor(place)), None)
                ranks.setdefault((n, math.ceil(place)), None)
    values = order_statistics(numbers, counts, list(ranks), min(limit, BRACKET))
    out = {}
    for c, n in zip(columns, names):
        out[c] = []
        for p in probs:
            if not counts[n]:
                out[c].append(None)
                continue
            place = (counts[n] - 1) * p
            low, high = math.floor(place), math.ceil(place)
            a, b = values[(n, low)], values[(n, high)]
            out[c].append(a if low == high or a == b else (high - place) * a + (place - low) * b)
    return out


def order_statistics(df: DataFrame, counts: dict, targets: list[tuple[str, int]], limit: int) -> dict:
    """Value at each (column, 0-based rank): narrow an open interval until it holds few rows."""
    found, many = {}, len(targets) > TARGETS
    span = {t: (None, None, 0, counts[t[0]]) for t in targets}  # low, high, rows below, rows inside

    def inside(name, low, high):
        x = F.col(name)
        keep = x.isNotNull()
        if low is not None:
            keep = keep & (x > F.lit(low))
        if high is not None:
            keep = keep & (x < F.lit(high))
        return keep

    while True:
        wide = [t for t in span if t not in found and span[t][3] > limit]
        if not wide:
            break
        # Targets that still share an interval share one sketch of it.
        shared = {}
        for t in wide:
            low, high, below, rows = span[t]
            p = (t[1] - below + 0.5) / rows
            ends = shared.setdefault((t[0], low, high), [])
            ends += [max(0.0, p - 2.0 / _ACCURACY), min(1.0, p + 2.0 / _ACCURACY)]
        sketches = _sketches(df, shared) if many else agg_row(df, {
            key: F.percentile_approx(F.when(inside(*key), F.col(key[0])), F.array(*[F.lit(e) for e in ends]), _ACCURACY)
            for key, ends in shared.items()
        }, batch=25)
        cuts, used = {}, {key: iter(values) for key, values in sketches.items()}
        for t in wide:
            values = used[(t[0], span[t][0], span[t][1])]
            cuts[t] = (next(values), next(values))
        lines = {n: np.unique([c for t in wide if t[0] == n for c in cuts[t]]).tolist() for n in {t[0] for t in wide}}  # NaN once, last
        seen = _counts_at(df, lines, many)
        # All cuts of a column narrow each of its targets, so intervals are equal or disjoint.
        for t in wide:
            low, high, below, rows = span[t]
            upto = below + rows
            for cut in lines[t[0]]:
                if (low is not None and cut <= low) or (high is not None and cut >= high):
                    continue
                if t[1] < seen[(t[0], cut, "lt")]:
                    high, upto = cut, seen[(t[0], cut, "lt")]
                    break
                if t[1] < seen[(t[0], cut, "le")]:
                    found[t] = cut
                    break
                low, below = cut, seen[(t[0], cut, "le")]
            span[t] = (low, high, below, upto - below)
    rest = {}
    for t in span:
        if t not in found:
            rest.setdefault((t[0], *span[t][:2]), []).append(t)
    if rest and many:
        wanted = [(i, [t[1] - span[t][2] + 1 for t in ts]) for i, ts in enumerate(rest.values())]
        lists = _inside(df, list(rest)).groupBy("k").agg(F.sort_array(F.flatten(F.collect_list("xs"))).alias("xs"))
        ranks = F.broadcast(df.sparkSession.createDataFrame(wanted, "k int, ranks array<int>"))  # the targets: as many as the answer
        keys = list(rest.values())
        for k, values in lists.join(ranks, "k").select("k", F.transform("ranks", lambda r: F.element_at("xs", r))).collect():
            found.update(zip(keys[k], values))
    elif rest:
        # Each interval is gathered once, at most `limit` values, and all its ranks are read from it.
        place = {}
        for i, key in enumerate(rest):
            hit = place.get(key[0])
            place[key[0]] = F.when(inside(*key), i) if hit is None else hit.when(inside(*key), i)
        tags = F.array(*[F.struct(p.alias("k"), F.col(n).alias("x")) for n, p in place.items()])
        lists = df.select(F.inline(tags)).where("k is not null").groupBy("k").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        keys = list(rest.values())
        ranks = F.array(*[F.array(*[F.lit(t[1] - span[t][2] + 1) for t in ts]) for ts in keys])
        picked = lists.select("k", F.transform(F.element_at(ranks, F.col("k") + 1), lambda r: F.element_at("xs", r.cast("int"))))
        for k, values in picked.collect():
            found.update(zip(keys[k], values))
    return found


def _position(x: Column, cuts: list[float]) -> Column:
    """2i + 1 where x equals the i-th cut, 2i where it lies below it (and above the one before), by binary search."""
    def search(first: int, last: int) -> Column:
        if first == last:
            return F.lit(2 * first)
        middle = (first + last) // 2
        cut = F.lit(cuts[middle])
        return F.when(x < cut, search(first, middle)).when(x == cut, F.lit(2 * middle + 1)).otherwise(search(middle + 1, last))

    return search(0, len(cuts))


def _counts_at(df: DataFrame, cuts: dict[str, list[float]], many: bool) -> dict:
    """Rows below and up to each cut of each column: one pass, combined map-side to a few counts per column."""
    names = list(cuts)
    if many:
        counted = df.select(*names).mapInArrow(_count(list(cuts.values())), "c int, p int, n long").groupBy("c", "p").agg(F.sum("n")).collect()
    else:
        places = F.array(*[
            F.struct(F.lit(i).alias("c"), F.when(F.col(n).isNotNull(), _position(F.col(n), cuts[n])).alias("p")) for i, n in enumerate(names)
        ])
        counted = df.select(F.inline(places)).where("p is not null").groupBy("c", "p").agg(F.count(F.lit(1))).collect()
    found = {(c, p): n for c, p, n in counted}
    out = {}
    for i, n in enumerate(names):
        total = 0
        for j, cut in enumerate(cuts[n]):
            total += found.get((i, 2 * j), 0)
            out[(n, cut, "lt")] = total
            total += found.get((i, 2 * j + 1), 0)
            out[(n, cut, "le")] = total
    return out


def _places(values: pa.Array, cuts: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """The values that are not null and their :func:`_position`; NaN is the largest value, as it is in Spark."""
    x = values.drop_null().to_numpy(zero_copy_only=False)
    return x, np.searchsorted(cuts, x, "left") + np.searchsorted(cuts, x, "right")


def _count(cuts: list[list[float]]):
    """Per partition: (column, position, number of values)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(2 * len(edges) + 1, np.int64) for edges in cuts]
        for batch in batches:
            for total, values, edges in zip(totals, batch.columns, cuts):
                total += np.bincount(_places(values, edges)[1], minlength=len(total))
        for c, total in enumerate(totals):
            p = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"c": pa.array(np.full(len(p), c, np.int32)), "p": pa.array(p.astype(np.int32)), "n": pa.array(total[p])})

    return run


def _inside(df: DataFrame, intervals: list[tuple]) -> DataFrame:
    """(k, xs): values of some rows inside the k-th open interval (column, low, high); those of a column are disjoint."""
    names = sorted({name for name, _, _ in intervals})
    # No end lies inside an interval, so the values inside are those between two neighbouring ends.
    ends = [np.unique([float(e) for name, *both in intervals if name == n for e in both if e is not None]) for n in names]
    owner = [np.full(2 * len(e) + 1, -1, np.int32) for e in ends]
    for k, (name, low, _) in enumerate(intervals):
        c = names.index(name)
        owner[c][0 if low is None else 2 * np.searchsorted(ends[c], low) + 2] = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, edges, of in zip(batch.columns, ends, owner):
                x, p = _places(values, edges)
                k = of[p]
                x, k = x[k >= 0], k[k >= 0]
                order = np.argsort(k, kind="stable")
                held, starts = np.unique(k[order], return_index=True)
                xs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(k)), pa.int32()), pa.array(x[order]))
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), xs], ["k", "xs"])

    return df.select(*names).mapInArrow(run, "k int, xs array<double>")


def _sketches(df: DataFrame, shared: dict[tuple, list[float]]) -> dict:
    """Values near the shares ``shared[interval]`` of each interval, pairs of a lower and an upper one, by one sketch per interval."""
    steps = _ACCURACY // 2
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    values = _inside(df, list(shared)).select("k", F.explode("xs").alias("x"))
    found = dict(values.groupBy("k").agg(F.percentile_approx("x", grid, _ACCURACY)).collect())
    return {
        key: [found[k][math.ceil(e * steps) if i % 2 else math.floor(e * steps)] for i, e in enumerate(ends)]
        for k, (key, ends) in enumerate(shared.items())
    }


def group_quantiles(
    df: DataFrame, by: list[str], value: str, probs: list[float], name: str = "q", split: bool | None = None
) -> DataFrame:
    """Exact quantiles per group as array column ``name``; past ``DIRECT`` values a group is ranked in blocks."""
    rows = df.select(*by, col(value).cast("double").alias("__v")).where("__v is not null")
    if split is None:
        split = ordered.largest_group(rows, by) > min(DIRECT, max_group_rows(df.sparkSession))
    if not split:
        return rows.groupBy(*by).agg(F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs])).alias(name))
    # Equal values first collapse to one counted row, then running counts give their ranks.
    counted = rows.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    ranked = ordered.scan(counted, by, ["__v"], [ordered.running("__upto", "sum", "__n")], split=True)
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__total"))
    keys = [F.col(f"r.{b}").eqNullSafe(F.col(f"t.{b}")) for b in by]
    joined = ranked.alias("r").join(totals.alias("t"), keys, "inner").select("r.*", "t.__total")
    picks = []
    for i, p in enumerate(probs):
        place = (F.col("__total") - 1) * F.lit(float(p))
        at = lambda rank: F.max(F.when((F.col("__upto") > rank) & (F.col("__upto") - F.col("__n") <= rank), F.col("__v")))
        picks += [at(F.floor(place)).alias(f"__a{i}"), at(F.ceil(place)).alias(f"__b{i}"), F.max(place).alias(f"__p{i}")]
    found = joined.groupBy(*by).agg(*picks)
    values = []
    for i in range(len(probs)):
        a, b, place = F.col(f"__a{i}"), F.col(f"__b{i}"), F.col(f"__p{i}")
        between = (F.ceil(place) - place) * a + (place - F.floor(place)) * b
        values.append(F.when(a == b, a).otherwise(between))
    return found.select(*by, F.array(*values).alias(name))
