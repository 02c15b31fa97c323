"""Centroid clustering against plain Lloyd rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from gridlens.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, rounds, dims, scale, seed):
    """Every vector against every centroid, in whole numbers."""
    kept = []
    for vec_id, vector, *_ in rows:
        if vector is not None and len(vector) == dims and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in vector]))
    text = lambda i: "" if i is None else str(i)
    at = [v for _, v in sorted((hashlib.sha256(f"{seed}:{text(i)}".encode()).hexdigest(), v) for i, v in kept)][:k]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for j in range(len(at)):
            own = [v for (_, v), (_, c) in zip(kept, of) if c == j]
            if own:
                at[j] = [sum(x) // len(own) for x in zip(*own)]
    of = assign()
    total = sum(d for d, _ in of)
    by = [sum(d for d, c in of if c == j) for j in range(len(at))]
    return sorted(((i, c, d, by[c], total, at[c]) for (i, _), (d, c) in zip(kept, of)), key=repr)


def got(frame, **settings):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in centroids.cluster(frame, **settings).collect()), key=repr)


def vectors(n, dims, seed, spread=1.0, centres=7):
    rng = random.Random(seed)
    middle = [[rng.uniform(-spread, spread) for _ in range(dims)] for _ in range(centres)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, spread / 6))) for x in rng.choice(middle)], 0) for i in range(n)]
    rows += [(None, rows[0][1], 1), (None, None, 1), (1, rows[1][1], 1), (n, [None] * dims, 1), (n + 1, [], 1), (n + 2, [1.0] * (dims + 1), 1)]
    rows += [(n + 3, [float("nan")] + [0.0] * (dims - 1), 1), (n + 4, [float("inf")] + [0.0] * (dims - 1), 1)]
    return rows + [(n + 10 + i, rows[2][1], 2) for i in range(n // 3)]  # copies: a third of all


@pytest.mark.parametrize("n,dims,k,spread", [(120, 4, 9, 1.0), (60, 2, 12, 0.02), (90, 3, 1, 5.0), (3, 4, 40, 1.0), (200, 8, 20, 20000.0)])
def test_equals_plain_rounds(spark, n, dims, k, spread, monkeypatch):
    rows = vectors(n, dims, n, spread)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    settings = dict(k=k, rounds=4, dims=dims, scale=256, seed=2)
    assert got(frame, **settings) == plain(rows, **settings)


def test_only_expired_vectors_are_compared_again(spark):
    rows = vectors(600, 4, 1, centres=12)
    frame = centroids.integers(spark.createDataFrame(rows, SCHEMA).repartition(3), 4, 256)
    now = centroids.Centroids.begin(centroids.first_centroids(frame, 12, 2))
    state, popped = centroids.stage(centroids.begin(frame, now), "test-centroids"), []
    for r in range(6):
        now = now.moved(centroids.changes(state))
        state = centroids.stage(centroids.again(state, now), f"test-centroids-{r}")
        popped.append(sum(x.popped for x in state.select("popped").collect()))
    assert popped[-1] < 600 and popped[-1] < popped[0]


def test_other_columns_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [0.5, 0.25], "a", "b"), (2, [-0.5, 0.25], "a", "b")], "vec_id long, embedding array<double>, cluster string, v string")
    assert got(frame, k=2, rounds=2, dims=2, scale=256) == plain([tuple(r) for r in frame.collect()], 2, 2, 2, 256, 2)
    nothing = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(nothing).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"] and centroids.cluster(nothing).count() == 0


def test_components_out_of_range_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large|OVERFLOW"):
        centroids.cluster(frame, k=2, rounds=1, dims=2).collect()
