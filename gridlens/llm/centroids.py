"""Centroid clustering: Lloyd's rounds over integer vectors, with heap-ordered bounds.

Each vector has an upper bound on the distance to its own centroid and a lower bound on the distance to any other one. What counts is their
gap: as long as it is above what the centroids can have closed since (their drift), the nearest centroid can't have changed. Instead of
lowering the bounds of all vectors in each round, a cluster adds up its drift, and a vector enters the heap of its cluster with its gap plus
the drift so far. The head of the heap is the gap that expires first, so a round pops the heads that the drift has reached, compares these
vectors with all centroids again, and leaves the others alone (Hamerly and Drake, "Accelerating Lloyd's algorithm for k-means clustering", 2015).

A block of some thousand vectors with its heaps is one row of a staged table, so a round is a narrow scan from one table to the next
without a shuffle. Each block gives the sums of what joined and left a cluster, which are added up to the new centroids. Centroids and drifts (``k`` x
``dims`` numbers) are all that goes through the driver. A vector's place among the blocks has no influence on the result.

Results are exact: vectors and centroids are integers, squared distances are integers, and bounds are rounded to the safe side. Ties go to the smaller
number. Vectors with another number of components, or with null or non-finite ones, aren't kept. A component beyond the range in which squared
distances fit 64 bits raises an error. Repeated rows are vectors of their own; ids may repeat or be null (a null id hashes as an empty one).
With fewer than ``k`` vectors there are fewer clusters; an empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import discard, stage

#: Vectors of a block.
BLOCK = 2048
#: Numbers that all centroids together may hold, since they go to every task.
CENTROID_NUMBERS = 4_000_000
#: Bounds are widened by this share, far more than doubles lose.
SLACK = 1e-12
STATE = "ids array<long>, data binary, width int, keys binary, rows binary, sizes array<int>, moved array<struct<cluster:int,n:long,sums:array<long>>>, popped int"


def integers(table: DataFrame, dims: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the kept vectors as integers, floor(scale * x)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = table.filter((F.size(vector) == dims) & finite)
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``; equal hashes by their components."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(text, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


@dataclass
class Centroids:
    """What a round needs to know: the centroids and how far each cluster has drifted in all rounds."""

    at: np.ndarray
    drift: np.ndarray
    counts: list[int] = field(default_factory=list)
    sums: list[list[int]] = field(default_factory=list)

    @classmethod
    def begin(cls, at: np.ndarray) -> Centroids:
        k, dims = at.shape
        return cls(at, np.zeros(k), [0] * k, [[0] * dims for _ in range(k)])

    def moved(self, changes: list[tuple[int, int, int, int]]) -> Centroids:
        """After an update by (cluster, change of its count, component, change of its sum)."""
        counts, sums = list(self.counts), [list(s) for s in self.sums]
        for cluster, n, component, change in changes:
            sums[cluster][component] += change
            if component == 0:
                counts[cluster] += n
        at = self.at.copy()
        for cluster, n in enumerate(counts):
            if n:
                at[cluster] = [s // n for s in sums[cluster]]
        moves = np.sqrt(((at - self.at).astype(np.float64) ** 2).sum(1))
        order = np.sort(moves)
        others = np.where(moves == order[-1], order[-2], order[-1]) if len(order) > 1 else np.zeros(1)  # the farthest move of another one
        return Centroids(at, self.drift + (moves + others) * (1 + SLACK), counts, sums)


def squared(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to all centroids."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(at).max(initial=0)))
    kind = np.float64 if 4 * at.shape[1] * largest * largest < 1 << 53 else np.int64  # whole numbers below 2^53 are exact in doubles
    x, c = points.astype(kind), at.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def nearest(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point (ties: the smaller number) and the gap between the bounds, rounded down."""
    distances = squared(points, at)
    best, row = distances.argmin(1), np.arange(len(points))
    upper = np.sqrt(distances[row, best])
    others = distances.astype(np.float64)
    others[row, best] = np.inf
    lower = np.sqrt(others.min(1))
    return best, lower * (1 - SLACK) - upper * (1 + SLACK)


def packed(points: np.ndarray, dims: int) -> tuple[bytes, int]:
    largest = int(np.abs(points).max(initial=0))
    if largest > math.isqrt((1 << 61) // dims):
        raise ValueError(f"a component of {largest} is too large for squared distances of 64 bits")
    width = 2 if largest < 1 << 15 else 4
    return points.astype(f"<i{width}").tobytes(), width


def unpacked(row: dict, dims: int) -> np.ndarray:
    return np.frombuffer(row["data"], f"<i{row['width']}").reshape(-1, dims).astype(np.int64)


def heaps_of(row: dict) -> list[list[tuple[float, int]]]:
    keys, rows, at, heaps = np.frombuffer(row["keys"], "<f8").tolist(), np.frombuffer(row["rows"], "<i4").tolist(), 0, []
    for n in row["sizes"]:
        heaps.append(list(zip(keys[at: at + n], rows[at: at + n])))
        at += n
    return heaps


def changes_of(points: np.ndarray, left: np.ndarray | None, joined: np.ndarray, k: int) -> list[dict]:
    """What the clusters of a block gain and lose, for those that change."""
    counts, sums = np.bincount(joined, minlength=k).astype(np.int64), np.zeros((k, points.shape[1]), np.int64)
    np.add.at(sums, joined, points)
    touched = counts > 0
    if left is not None:
        gone = np.bincount(left, minlength=k)
        touched |= gone > 0
        counts -= gone
        np.subtract.at(sums, left, points)
    return [{"cluster": int(c), "n": int(counts[c]), "sums": sums[c].tolist()} for c in np.flatnonzero(touched)]


def state_row(ids: list, data: bytes, width: int, heaps: list[list[tuple[float, int]]], moved: list[dict], popped: int) -> dict:
    entries = [e for heap in heaps for e in heap]
    keys, rows = np.array([e[0] for e in entries], "<f8"), np.array([e[1] for e in entries], "<i4")
    return {"ids": ids, "data": data, "width": width, "keys": keys.tobytes(), "rows": rows.tobytes(), "sizes": [len(h) for h in heaps], "moved": moved, "popped": popped}


def arrow_batch(rows: list[dict]) -> pa.RecordBatch:
    moved = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
    kinds = {"ids": pa.list_(pa.int64()), "data": pa.binary(), "width": pa.int32(), "keys": pa.binary(), "rows": pa.binary(), "sizes": pa.list_(pa.int32()), "moved": moved, "popped": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()], names=list(kinds))


def begin(vectors: DataFrame, now: Centroids) -> DataFrame:
    """The blocks, after each vector has been compared with all centroids."""
    at, k, dims = now.at, *now.at.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                points = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                data, width = packed(points, dims)
                best, gap = nearest(points, at)
                heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]
                for row, (cluster, key) in enumerate(zip(best.tolist(), gap.tolist())):
                    heaps[cluster].append((key, row))
                for heap in heaps:
                    heapify(heap)
                yield arrow_batch([state_row(part.column(0).to_pylist(), data, width, heaps, changes_of(points, None, best, k), len(points))])

    return vectors.select("vec_id", "v").mapInArrow(run, STATE)


def again(state: DataFrame, now: Centroids) -> DataFrame:
    """The blocks one round on: only vectors whose gap has expired are compared with all centroids."""
    at, k, dims = now.at, *now.at.shape
    limit = now.drift.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                heaps, popped, left = heaps_of(row), [], []
                for cluster, heap in enumerate(heaps):
                    while heap and heap[0][0] <= limit[cluster]:
                        popped.append(heappop(heap)[1])
                        left.append(cluster)
                moved = []
                if popped:
                    points = unpacked(row, dims)[popped]
                    best, gap = nearest(points, at)
                    for n, cluster, key in zip(popped, best.tolist(), gap.tolist()):
                        heappush(heaps[cluster], (key + limit[cluster] * (1 - SLACK), n))
                    other = np.flatnonzero(best != np.array(left))
                    moved = changes_of(points[other], np.array(left)[other], best[other], k)
                yield arrow_batch([state_row(row["ids"], row["data"], row["width"], heaps, moved, len(popped))])

    return state.mapInArrow(run, STATE)


def changes(state: DataFrame) -> list[tuple[int, int, int, int]]:
    """Sums over all blocks, a row per cluster and component: ``k`` x ``dims`` rows at most."""
    each = state.select(F.explode("moved").alias("m")).select("m.cluster", "m.n", F.posexplode("m.sums").alias("component", "change"))
    rows = each.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum("change").alias("change")).collect()
    return [(r.cluster, r.n, r.component, r.change) for r in rows]


def assigned(state: DataFrame, now: Centroids) -> DataFrame:
    """(vec_id, cluster, distance) of all vectors."""
    at, dims = now.at, now.at.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                points, cluster = unpacked(row, dims), np.zeros(len(row["ids"]), np.int32)
                cluster[np.frombuffer(row["rows"], "<i4")] = np.repeat(np.arange(len(row["sizes"]), dtype=np.int32), row["sizes"])
                distance = ((points - at[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, and centroid (the components of the cluster's final centroid) of each kept vector."""
    spark = table.sparkSession
    if k * dims > CENTROID_NUMBERS:
        raise ValueError(f"{k} centroids of {dims} components are too many for every task")
    vectors = integers(table, dims, scale, vec_id, vector)
    at = first_centroids(vectors, k, seed)
    if not len(at):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    now = Centroids.begin(at)
    state = stage(begin(vectors, now), "centroids-0")
    for r in range(rounds):
        now = now.moved(changes(state))
        older, state = state, stage(again(state, now), f"centroids-{r + 1}")
        discard(older)
    rows = stage(assigned(state, now), "centroids-assigned")
    discard(state)
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    clusters = [(c, s, sum(sums.values()), now.at[c].tolist()) for c, s in sums.items()]
    of = spark.createDataFrame(clusters, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows
