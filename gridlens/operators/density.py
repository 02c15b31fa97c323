"""Density clusters (DBSCAN) of vectors of any width, exact.

Points within ``eps`` are found by a join through pivots (meeting.py): a point belongs to the cell of a near pivot, cells are cut into blocks
of bounded size, ordered by the distance to the pivot, and a group of points meets the blocks that can hold something within ``eps`` of one of them, by the
rings of blocks around their pivots. A first pass only counts, so no pairs are written; a second one unites the core points of a group through the
core points it meets and writes one link per point and group. In many dimensions the bounds exclude little, and the work comes near
that of all pairs, block by block.

Ids are unique. Equal vectors are one counted point. Rows whose vector is null, holds a null or a NaN, or is shorter than the
longest one of the table are noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators import graph, meeting
from gridlens.operators.meeting import CHUNK, _pair_distances
from gridlens.session import cut_lineage


def clusters(df: DataFrame, row_id: str, features: str, eps: float, min_points: int, seed: int = 42,
             pivots: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(id, cluster, kind): kind is core (``min_points`` rows within ``eps``, itself included), border or noise.

    A cluster is named after its smallest core id; a border row joins the cluster with the smallest name among its core
    neighbours; the cluster of noise is null.
    """
    source = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(features).cast("array<double>").alias("x"))
    width = source.agg(F.max(F.size("x"))).first()[0] or 0
    whole = (F.size("x") == width) & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    keyed = source.withColumn("key", F.when(F.coalesce(whole, F.lit(False)), F.sha2(F.to_json(F.struct("x")), 256)))
    distinct = cut_lineage(keyed.where("key is not null").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"), F.first("x").alias("x")))
    total = distinct.count()
    if total == 0:
        return source.select("id", F.lit(None).cast("bigint").alias("cluster"), F.lit("noise").alias("kind"))
    centres = meeting._pivots(distinct, pivots or max(1, min(2048, total // max(1, chunk // 4))), seed)
    chunked = meeting.chunks(meeting.homes(distinct.select("rep", "x", "n"), centres, "rep bigint, x array<double>, n bigint"), chunk)
    layout = meeting.Layout.of(meeting.rings(chunked), centres)
    blocks = meeting.pack(chunked, layout, ["n"])
    where = meeting.plan(blocks, layout, layout, lambda _, x: np.full(len(x), eps))

    # Each point and its group's part of the rows within reach, added up per point.
    counted = meeting.meet(blocks, blocks, where, layout, lambda *group: _Count(eps, *group), "rep bigint, near bigint")
    cores = cut_lineage(counted.groupBy("rep").agg(F.sum("near").alias("near")).select("rep", (F.col("near") >= min_points).alias("core")))

    # Among core points only: links of the united parts of a group, and for others the parts they touch.
    marked = chunked.join(cores, "rep").withColumn("core", F.col("core").cast("int"))
    asking, members = meeting.pack(marked, layout, ["core"]), meeting.pack(marked.where("core = 1"), layout, ["core"])
    links = cut_lineage(meeting.meet(asking, members, where, layout, lambda *group: _Unite(eps, *group), "a bigint, b bigint, core boolean"))
    own = cores.where("core").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    parts = graph.components(graph.undirected_edges(links.where("core").select("a", "b").unionByName(own), "a", "b"))
    # Border points touch a core point; its cluster is known by now.
    border = links.where("not core").join(parts.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("component").alias("cluster"))
    named = parts.select(F.col("node").alias("rep"), F.col("component").alias("cluster"), F.lit("core").alias("kind")).unionByName(
        border.withColumn("kind", F.lit("border")))
    by_key = distinct.select("key", "rep").join(named, "rep").drop("rep")
    return keyed.join(by_key, "key", "left").select("id", "cluster", F.coalesce("kind", F.lit("noise")).alias("kind"))


class _Reach(meeting.Visitor):
    """The points of a group, with those members of a block that lie within ``eps``."""

    def __init__(self, eps: float, layout: meeting.Layout, reps: np.ndarray, x: np.ndarray, more: np.ndarray):
        super().__init__(layout, reps, x, np.full(len(x), eps))
        self.eps, self.more = eps, more[:, 0]

    def close(self, block: int, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of the point, place of the member), some points at a time; pairs within rounding of ``eps`` are added up by coordinate."""
        for rows in self.slices(block):
            i, j, sure = self.within(rows, x)
            unsure = np.flatnonzero(~sure)
            near = sure.copy()
            near[unsure] = _pair_distances(self.x[rows], x, i[unsure], j[unsure]) <= self.eps
            yield rows[i[near]], j[near]


class _Count(_Reach):
    """Rows within reach of each point."""

    def __init__(self, *group):
        super().__init__(*group)
        self.near = np.zeros(len(self.x))

    def meet(self, block: int, reps: np.ndarray, x: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, j in self.close(block, x):
            self.near += np.bincount(i, more[j, 0], len(self.near))
        return iter(())

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(self.reps), pa.array(self.near.astype(np.int64))], ["rep", "near"])


def _united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` numbers is linked with."""
    name = np.arange(n)
    while True:
        least, new = np.minimum(name[a], name[b]), name.copy()
        np.minimum.at(new, name[a], least)
        np.minimum.at(new, name[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, name):
            return name
        name = new


class _Unite(_Reach):
    """Parts of the core points of a group, named by a place in it; members of a block are places behind those of the group."""

    def __init__(self, *group):
        super().__init__(*group)
        self.name = np.arange(len(self.x))

    def meet(self, block: int, reps: np.ndarray, x: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, others = len(self.x), []
        held = n + np.arange(len(x))
        for i, j in self.close(block, x):
            core = self.more[i] > 0
            others.append((i[~core], j[~core]))
            edges = np.unique(self.name[i[core]] * (n + len(x)) + held[j[core]])
            part = _united(n + len(x), *np.divmod(edges, n + len(x)))
            self.name, held = part[self.name], part[held]
        names = np.concatenate([self.reps, reps])
        linked = held < n
        yield _links(reps[linked], names[held[linked]], True)
        if others:
            i, j = (np.concatenate(c) for c in zip(*others))
            i, part = np.divmod(np.unique(i * (n + len(x)) + held[j]), n + len(x))
            yield _links(self.reps[i], names[part], False)

    def finish(self) -> Iterator[pa.RecordBatch]:
        moved = self.name != np.arange(len(self.name))
        yield _links(self.reps[moved], self.reps[self.name[moved]], True)


def _links(a: np.ndarray, b: np.ndarray, core: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), core))], ["a", "b", "core"])
