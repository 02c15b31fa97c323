import numpy as np
import pytest

from gridlens.operators import meeting, neighbors


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(4)


@pytest.mark.parametrize("d", [2, 12])
def test_nearest_over_groups_and_lanes(spark, monkeypatch, d):
    """A block is written once per group that may need it, and not once per query and cell; groups and lanes are bounded."""
    for name, value in (("GROUPS", 5), ("LANE_ROWS", 90), ("PAIRS", 50)):
        monkeypatch.setattr(meeting, name, value)
    plans, plan = [], meeting.plan
    monkeypatch.setattr(meeting, "plan", lambda *a: plans.append(plan(*a)) or plans[-1])
    draw = np.random.default_rng(d)
    x = np.vstack([draw.normal(0, 1, (280, d)), np.full((20, d), 0.5)])
    got = neighbors.knn(frame(spark, x), "id", "x", 4, chunk=16, pivots=12).collect()
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {(i, r + 1): j for i in range(len(x)) for r, j in enumerate([j for j in np.lexsort((np.arange(len(x)), dist[i])) if j != i][:4])}
    assert {(r["id"], r["rank"]): r["neighbor"] for r in got} == want
    sent, blocks = plans[0].members.count(), plans[0].members.select("block").distinct().count()
    assert plans[0].tasks > 5 and sent <= 7 * blocks and plans[0].members.distinct().count() == sent


def test_what_a_visitor_holds_is_bounded(monkeypatch):
    """All members lie within the first bound of the points, and what is kept of them stays near k a point."""
    monkeypatch.setattr(meeting, "PAIRS", 500)
    draw = np.random.default_rng(3)
    q, x = draw.normal(0, 1, (100, 8)), draw.normal(0, 1, (4000, 8))
    layout = meeting.Layout(np.zeros((1, 8)), np.zeros(40, int), np.arange(40), np.zeros(40), np.full(40, 99.0), np.full(40, 100))
    visit, held = meeting.Nearest(3, layout, np.arange(100), q, np.zeros((100, 0))), []
    for b in range(40):
        list(visit.meet(b, np.arange(100 * b, 100 * b + 100), x[100 * b:100 * b + 100], np.zeros((100, 0))))
        held.append(visit.waiting)
    rows = [r for batch in visit.finish() for r in batch.to_pylist()]
    want = np.argsort(((q[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, :3]
    assert [r["rep"] for r in rows] == want.ravel().tolist() and max(held[5:]) < 2 * 500
