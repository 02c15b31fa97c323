import numpy as np
import pytest

from gridlens.operators import novelty


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(4)


def brute(seen, new, k):
    """Scores of new rows by the definition; ties by place."""
    def near(q, skip=None):
        d = np.sqrt(((seen - q) ** 2).sum(axis=1))
        return [(d[i], i) for i in sorted((i for i in range(len(seen)) if i != skip), key=lambda i: (d[i], i))[:k]]

    own = [near(q, i) for i, q in enumerate(seen)]
    far = [n[-1][0] for n in own]
    dense = lambda n: 1 / (np.mean([max(d, far[i]) for d, i in n]) + 1e-10)
    lrd = [dense(n) for n in own]
    score = lambda n, mine: np.mean([lrd[i] for _, i in n]) / mine
    limit = np.quantile([score(n, l) for n, l in zip(own, lrd)], 0.9)
    out = [score(near(q), dense(near(q))) for q in new]
    return out, [s > limit for s in out]


@pytest.mark.parametrize("chunk,pivots,load", [(2000, None, 8000), (16, 7, 5)])
def test_lof_of_new_rows(spark, tmp_path, chunk, pivots, load):
    draw = np.random.default_rng(3)
    seen = draw.permutation(np.vstack([draw.normal(0, 1, (120, 5)), draw.normal(6, 0.2, (40, 5)), np.full((70, 5), 3.0)]))  # 70 copies
    new = np.vstack([draw.normal(0, 1, (30, 5)), [[50.0] * 5], np.full((9, 5), 3.0), draw.normal(6, 0.2, (8, 5)), seen[:6]])
    novelty.fit_lof(frame(spark, seen), "id", "x", 8, str(tmp_path / "m"), chunk=chunk, pivots=pivots)
    got = {r["id"]: (r["score"], r["novel"]) for r in novelty.score_lof(frame(spark, new), "x", str(tmp_path / "m"), load=load).collect()}
    scores, flags = brute(seen, new, 8)
    assert len(got) == len(new) and got[30][1]
    for i, (s, f) in enumerate(zip(scores, flags)):
        assert got[i][0] == pytest.approx(s, rel=1e-9) and got[i][1] == f


def test_odd_rows(spark, tmp_path):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [None, 1.0]), (7, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>").selectExpr("id", "x", "'clash' AS score", "1 AS key", "2 AS cell")
    for kind, fit, score in (("a", lambda d, p: novelty.fit_lof(d, "id", "x", 2, p), novelty.score_lof),
                             ("b", lambda d, p: novelty.fit_one_class(d, "id", "x", p), novelty.score_usual)):
        path = str(tmp_path / kind)
        fit(df, path)
        got = {r["id"]: r for r in score(df, "x", path).collect()}
        assert [got[i]["score"] is None for i in range(1, 8)] == [False] * 3 + [True] * 4 and not any(got[i]["novel"] for i in range(4, 8))
        assert got[1]["key"] == 1 and score(df.where("id < 0"), "x", path).count() == 0
        fit(df.where("id < 0"), path)
        assert {(r["score"], r["novel"]) for r in score(df, "x", path).collect()} == {(None, False)}


def test_planted_outliers(spark, tmp_path):
    draw = np.random.default_rng(5)
    seen = np.vstack([draw.normal(0, 1, (300, 4)), draw.normal(8, 0.5, (300, 4))])
    new = frame(spark, np.vstack([draw.normal(0, 0.4, (20, 4)), draw.normal(8, 0.2, (20, 4)), draw.normal(4, 0.2, (10, 4)), draw.normal(-9, 0.2, (10, 4))]))
    for kind, fit in (("one_class", novelty.fit_one_class), ("mixture", novelty.fit_mixture)):
        path = str(tmp_path / kind)
        fit(frame(spark, seen), "id", "x", path, share=0.05)
        got = {r["id"]: r["novel"] for r in novelty.score_usual(new, "x", path).collect()}
        assert all(got[i] for i in range(40, 60)) and sum(got[i] for i in range(40)) <= 2
        seen_flags = novelty.score_usual(frame(spark, seen), "x", path).where("novel").count()
        assert 25 <= seen_flags <= 31  # the share of trained rows
