"""Exact nearest neighbours, local outlier factor and density noise without a cross join.

k nearest (after Lu et al., "Efficient Processing of k Nearest Neighbor Joins using MapReduce",
2012): vectors go to the cell of their nearest pivot; by the triangle inequality a query
needs only cells that can hold something closer than a bound it already has. Cells are
cut into blocks of bounded size that meet in tasks of bounded size (meeting.py), so neither a hot cell
nor the pairs of a group ever sit in one place. Equal vectors
are collapsed first: a third of all rows being copies costs one vector.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators import meeting, ordered
from gridlens.operators.meeting import _SLACK, CHUNK, _distances, _pivots  # noqa: F401  # also used from here
from gridlens.session import cut_lineage


def knn(df: DataFrame, row_id: str, features: str, k: int, seed: int = 42, pivots: int | None = None,
        chunk: int = CHUNK) -> DataFrame:
    """(id, neighbor, distance, rank): the k nearest other rows of each row by (distance, id), exact.

    Of the distinct vectors the k + 1 nearest by (distance, smallest id) hold every answer: an id of any other comes after those k + 1.
    """
    source = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(features).cast("array<double>").alias("x"))
    keyed = source.withColumn("key", F.sha2(F.to_json(F.struct("x")), 256))
    # The k + 1 smallest ids of each distinct vector are enough for every copy's answer.
    ranked = ordered.scan(keyed.select("key", "id"), ["key"], ["id"], [ordered.row_number("rn")])
    few = ranked.where(F.col("rn") <= k + 1).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = keyed.groupBy("key").agg(F.min("id").alias("rep"), F.first("x").alias("x")).join(few, "key")
    distinct = cut_lineage(distinct.where("rep is not null").select("key", "rep", "x", "ids"))
    total = distinct.count()
    if total == 0:
        return source.select("id", F.col("id").alias("neighbor"), F.lit(0.0).alias("distance"), F.lit(1).cast("bigint").alias("rank"))
    centres = _pivots(distinct, pivots or max(1, min(2048, total // (chunk // 4))), seed)
    chunked = meeting.chunks(meeting.homes(distinct.select("rep", "x"), centres, "rep bigint, x array<double>"), chunk)
    layout = meeting.Layout.of(meeting.rings(chunked), centres)
    blocks = meeting.pack(chunked, layout, [])
    found = meeting.nearest(blocks, layout, blocks, layout, k + 1)
    # Merge per distinct vector; at most k + 1 ids are needed, and row limits are pushed below the shuffle.
    pairs = found.join(distinct.select("rep", "ids"), "rep").select("qrep", "distance", F.explode("ids").alias("neighbor"))
    best = _top(pairs, "qrep", k + 1)
    # Copies share the merged list; each drops itself from it.
    members = keyed.join(distinct.select("key", "rep"), "key").select("id", F.col("rep").alias("qrep"))
    expanded = members.join(best, "qrep").where("neighbor <> id").select("id", "neighbor", "distance")
    return _top(expanded, "id", k, keep_rank=True)


def _top(pairs: DataFrame, by: str, k: int, keep_rank: bool = False) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(by).orderBy("distance", "neighbor"))
    kept = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    return kept.withColumn("rank", F.col("rank").cast("bigint")) if keep_rank else kept.drop("rank")


def knn_vote(neighbors: DataFrame, labels: DataFrame, row_id: str, label: str) -> DataFrame:
    """Majority label among the neighbours, the smallest label on a tie."""
    known = labels.select(F.col(row_id).alias("neighbor"), F.col(label).alias("vote"))
    votes = neighbors.join(known, "neighbor").groupBy("id", "vote").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("id").agg(F.max(F.struct(F.col("n"), (-F.col("vote")).alias("v"))).alias("b"))
    return best.select("id", (-F.col("b.v")).alias("predicted"))


def local_outlier_factor(neighbors: DataFrame, k: int) -> DataFrame:
    """LOF from a k-nearest table: mean local reachability density of the neighbours over the row's own.

    All joins are on ids over k rows per point.
    """
    near = cut_lineage(neighbors)
    reach_of = near.groupBy("id").agg(F.max("distance").alias("k_distance"))
    reach = near.join(reach_of.withColumnRenamed("id", "neighbor"), "neighbor").select(
        "id", "neighbor", F.greatest("distance", "k_distance").alias("reach"))
    # A sum of zero (k copies at one place) counts as the tiny number that scaling libraries use.
    density = reach.groupBy("id").agg((F.count(F.lit(1)) / (F.sum("reach") + 1e-10 * F.count(F.lit(1)))).alias("lrd"))
    other = near.join(density.select(F.col("id").alias("neighbor"), F.col("lrd").alias("other")), "neighbor")
    return other.groupBy("id").agg(F.avg("other").alias("m")).join(density, "id").select("id", (F.col("m") / F.col("lrd")).alias("lof"))


def density_noise(df: DataFrame, row_id: str, columns: list[str], eps: float, min_points: int) -> DataFrame:
    """(id, noise): DBSCAN noise flags in one to three dimensions, exact and linear.

    Points are counted on a grid of side eps / sqrt(d): any two points of a cell are within eps. A
    cell with ``min_points`` rows is therefore all core with no distance computed. Only points of sparser
    cells look around, and a cell has few of those, so each point is met a bounded number of times.
    """
    d = len(columns)
    if not 1 <= d <= 3:
        raise ValueError("density_noise works in one to three dimensions; reduce the features first")
    side = eps / math.sqrt(d) * (1 - 1e-12)
    reach = math.ceil(eps / side)
    cell = F.array(*[F.floor(F.col(c).cast("double") / side).cast("bigint") for c in columns])
    point = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.select(F.col(row_id).alias("id"), cell.alias("cell"), point.alias("p"))
    # Copies collapse to one counted point.
    points = cut_lineage(rows.groupBy("cell", "p").agg(F.count(F.lit(1)).alias("n")))
    sizes = points.groupBy("cell").agg(F.sum("n").alias("size"))
    sized = points.join(sizes, "cell")
    sparse = sized.where(F.col("size") < min_points)
    dense_core = sized.where(F.col("size") >= min_points).select("cell", "p")

    ways = np.array(np.meshgrid(*[range(-reach, reach + 1)] * d)).reshape(d, -1).T
    # Cells whose nearest corners are farther than eps cannot matter.
    ways = [w for w in ways.tolist() if sum((max(abs(v) - 1, 0) * side) ** 2 for v in w) <= eps * eps * (1 + 1e-9)]
    offsets = F.array(*[F.array(*[F.lit(int(v)).cast("bigint") for v in w]) for w in ways])
    close = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) <= eps * eps

    def around(left: DataFrame) -> DataFrame:
        return left.select(F.col("p").alias("q"), F.explode(offsets).alias("w"), F.col("cell").alias("home")).select(
            "q", "home", F.zip_with("home", "w", lambda a, b: a + b).alias("cell"))

    counted = around(sparse).join(points, "cell").where(close("q", "p")).groupBy("home", "q").agg(F.sum("n").alias("near"))
    sparse_core = counted.where(F.col("near") >= min_points).select(F.col("home").alias("cell"), F.col("q").alias("p"))
    core = cut_lineage(dense_core.unionByName(sparse_core))
    rest = sparse.select("cell", "p").join(sparse_core, ["cell", "p"], "left_anti")
    border = around(rest).join(core, "cell").where(close("q", "p")).select(F.col("home").alias("cell"), F.col("q").alias("p")).distinct()
    noise = rest.join(border, ["cell", "p"], "left_anti").withColumn("noise", F.lit(True))
    return rows.join(noise, ["cell", "p"], "left").select("id", F.coalesce("noise", F.lit(False)).alias("noise"))
