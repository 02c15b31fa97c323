import numpy as np
import pytest

from gridlens.operators import density


def brute(x, eps, least):
    """(cluster, kind) of each row by the definition; ids are places."""
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    name = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.array([min(name[near[i] & core], default=len(x)) if core[i] else len(x) for i in range(len(x))])
        if np.array_equal(new, name):
            break
        name = new
    out = []
    for i in range(len(x)):
        at = min(name[near[i] & core], default=None)
        out.append((None, "noise") if at is None else (int(at), "core" if core[i] else "border"))
    return out


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(4)


@pytest.mark.parametrize("d,eps,chunk,pivots", [(1, 0.03, 2000, None), (2, 0.25, 16, 7), (6, 1.0, 8, 20)])
def test_equals_brute_force(spark, d, eps, chunk, pivots):
    draw = np.random.default_rng(d)
    x = np.round(np.vstack([draw.uniform(0, 3, (110, d)), draw.normal(1, 0.2, (40, d)), np.full((60, d), 2.5), draw.normal(4, 0.1, (12, d))]), 3)
    draw.shuffle(x)  # copies, at a third of the rows, lie everywhere
    want = brute(x, eps, 4)
    got = {r["id"]: (r["cluster"], r["kind"]) for r in density.clusters(frame(spark, x), "id", "x", eps, 4, chunk=chunk, pivots=pivots).collect()}
    assert [got[i] for i in range(len(x))] == want
    assert len({w[1] for w in want}) == 3 and len({w[0] for w in want}) > 3


def test_a_long_chain_is_one_cluster(spark):
    x = np.arange(150)[:, None] * 1.0  # each point only reaches its two neighbours
    got = density.clusters(frame(spark, np.hstack([x, x * 0])), "id", "x", 1.0, 3, chunk=8, pivots=9).collect()
    assert {r["cluster"] for r in got} == {1} and sorted(r["id"] for r in got if r["kind"] == "border") == [0, 149]


def test_rows_without_a_whole_vector(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.1]), (3, [0.1, 0.0]), (4, None), (5, []), (6, [0.0]), (7, [None, 0.0]), (8, [float("nan"), 0.0]), (9, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>").selectExpr("id", "x", "'clash' AS cluster", "1 AS rep")
    got = {r["id"]: (r["cluster"], r["kind"]) for r in density.clusters(df, "id", "x", 0.5, 3).collect()}
    assert got == {**{i: (1, "core") for i in (1, 2, 3)}, **{i: (None, "noise") for i in range(4, 10)}}
    assert density.clusters(df.where("id < 0"), "id", "x", 0.5, 3).count() == 0


def test_one_link_per_point_and_group(spark, monkeypatch):
    """However many blocks a point meets, no more than one link of it is written per group of points."""
    monkeypatch.setattr(density.meeting, "GROUPS", 3)
    plans, counts = [], []
    plan, edges = density.meeting.plan, density.graph.undirected_edges
    monkeypatch.setattr(density.meeting, "plan", lambda *a: plans.append(plan(*a)) or plans[-1])
    monkeypatch.setattr(density.graph, "undirected_edges", lambda df, *a: counts.append(df.count()) or edges(df, *a))
    x = np.random.default_rng(5).normal(0, 1, (240, 5))
    got = density.clusters(frame(spark, x), "id", "x", 9.0, 3, chunk=8, pivots=40).collect()
    assert {(r["cluster"], r["kind"]) for r in got} == {(0, "core")}
    assert plans[0].tasks <= 5 and counts[0] <= (plans[0].tasks + 2) * 240
