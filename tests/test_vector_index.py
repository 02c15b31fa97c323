import numpy as np
import pytest

from gridlens.operators import vector_index as vi


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(4)


def brute(x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        out[q] = [(i, d[i]) for i in sorted(range(len(x)), key=lambda i: (d[i], i)) if i != q][:k]
    return out


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(1)
    x = np.vstack([draw.normal(0, 1, (8, 24))[draw.integers(0, 8, 900)] + draw.normal(0, 0.3, (900, 24)), draw.normal(0, 1, (300, 24))])
    return draw.permutation(np.vstack([x, np.repeat(x[:1], 600, axis=0)]))  # a third are copies of one row


def test_recall_and_exact_distances(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK", 64)  # the copies' list has many blocks
    monkeypatch.setattr(vi, "VISITORS", 16)  # and their visitors many lanes
    df = frame(spark, rows)
    vi.build(df, "id", "x", str(tmp_path / "i"), k=10)
    index = vi.load(spark, str(tmp_path / "i"))
    assert index.probes < len(index.codec.centres) and index.depth < len(rows) / 2
    asked = list(range(0, len(rows), 20))
    want = brute(rows, asked, 10)
    got = {}
    for r in vi.search(index, df.where("id % 20 = 0"), "id", "x", 10).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"], r["distance"]))
    near = 0
    for q in asked:
        found = sorted(got[q])
        assert len(found) == 10 and [f[0] for f in found] == list(range(1, 11))
        for _, n, d in found:
            assert n != q and d == pytest.approx(np.sqrt(((rows[n] - rows[q]) ** 2).sum()))
        near += sum(d <= want[q][-1][1] + 1e-9 for _, _, d in found)
    assert near / (10 * len(asked)) >= 0.9
    assert vi.recall(spark, index) >= 0.9


def test_all_lists_are_exact(spark, rows, tmp_path):
    df = frame(spark, rows)
    index = vi.build(df, "id", "x", str(tmp_path / "i"), lists=9, k=5)
    found = vi.search(index, df.where("id < 40"), "id", "x", 5, probes=9, depth=len(rows))
    got = {(r["id"], r["rank"]): r["neighbor"] for r in found.collect()}
    for q, near in brute(rows, range(40), 5).items():
        assert [got[q, i + 1] for i in range(5)] == [n for n, _ in near]


def test_odd_rows(spark, tmp_path):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [1.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>").selectExpr("id", "x", "1 AS list", "'a' AS query")
    index = vi.build(df, "id", "x", str(tmp_path / "a"))
    got = [(r["id"], r["neighbor"], r["distance"]) for r in vi.search(index, df, "id", "x").collect()]
    assert sorted(got) == [(1, 2, 1.0), (2, 1, 1.0)]
    assert vi.search(index, df.where("id = 1"), "id", "x", others=False).count() == 2
    empty = vi.build(df.where("id < 0"), "id", "x", str(tmp_path / "b"))
    assert vi.search(vi.load(spark, str(tmp_path / "b")), df, "id", "x").count() == 0 and vi.recall(spark, empty) == 1.0
