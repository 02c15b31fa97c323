"""Blocks of vectors that meet: the exact joins of points by distance, bounded in memory.

Vectors go to the cell of a near pivot, and cells are cut into rings of bounded size around it; a ring is stored as one row, a block. Which blocks
can hold something near enough follows from the rings alone, block by block, so no row is written per point and cell. Query blocks
form groups (a fixed number of them until a group would be too large), and a task takes the points of one group and streams the member
blocks of one lane past them: it holds the group, one member block and what was found so far. So a vector is written once per group that may need it, not
once per cell, and in a task each point still skips the rings beyond its own bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.hashing import hash31
from gridlens.operators import ordered
from gridlens.session import cut_lineage, lookup

CHUNK = 2000
_SLACK = 1e-9  # relative room for rounding in distance bounds
#: Groups of query blocks, and the rows and bytes beyond which there are more of them.
GROUPS, GROUP_ROWS, GROUP_BYTES = 48, 1 << 16, 64 << 20
#: Rows of member blocks that one task streams.
LANE_ROWS = 1 << 18
#: Queries whose distances are computed at a time, pairs that are added up at a time, and rows of a batch.
SLICE, PAIRS, OUT = 1024, 1 << 18, 1 << 17


def _pivots(distinct: DataFrame, count: int, seed: int) -> np.ndarray:
    rows = distinct.orderBy(hash31("rep", seed), "rep").limit(count).select("x").collect()
    return np.array([r[0] for r in rows], dtype=float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs, summed by coordinate so that equal inputs give equal results in any block."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def _pair_distances(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same for the pairs (i, j)."""
    q, x, out = np.ascontiguousarray(q.T), np.ascontiguousarray(x.T), np.zeros(len(i))
    for some in range(0, len(i), PAIRS):
        a, b = i[some:some + PAIRS], j[some:some + PAIRS]
        for c in range(len(q)):
            out[some:some + PAIRS] += (q[c][a] - x[c][b]) ** 2
    return np.sqrt(out)


# ---- blocks --------------------------------------------------------------------------------------

def homes(rows: DataFrame, centres: np.ndarray, fields: str) -> DataFrame:
    """Rows (``fields``, with rep and x) with the cell of a nearest pivot and the distance to it."""
    norms = (centres ** 2).sum(axis=1)

    def home(batches):
        for b in batches:
            for first in range(0, len(b), SLICE):
                part = b.iloc[first:first + SLICE]
                x = np.stack(part["x"].to_numpy())
                cell = (norms[None] - 2 * (x @ centres.T)).argmin(axis=1)
                yield part.assign(cell=cell.astype("int32"), to_pivot=_pair_distances(x, centres, np.arange(len(x)), cell))

    return rows.mapInPandas(home, f"{fields}, cell int, to_pivot double")


def chunks(placed: DataFrame, chunk: int) -> DataFrame:
    """Rows with ``part``, the ring of their cell: position by the distance to the pivot, in pieces of ``chunk`` rows."""
    numbered = ordered.scan(cut_lineage(placed), ["cell"], ["to_pivot", "rep"], [ordered.row_number("rn")])
    return cut_lineage(numbered.withColumn("part", F.floor((F.col("rn") - 1) / chunk).cast("int")).drop("rn"))


def rings(chunked: DataFrame) -> DataFrame:
    """One row per block."""
    return chunked.groupBy("cell", "part").agg(F.min("to_pivot").alias("lo"), F.max("to_pivot").alias("hi"), F.count(F.lit(1)).alias("n"))


@dataclass
class Layout:
    """Pivots, and per block, by its number: cell, part, bounds of the distance to the pivot, and rows."""

    centres: np.ndarray
    cell: np.ndarray
    part: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, found: DataFrame, centres: np.ndarray) -> Layout:
        held = sorted(tuple(r) for r in found.select("cell", "part", "lo", "hi", "n").collect())  # one narrow row per block
        cell, part, lo, hi, n = zip(*held)
        return cls(np.asarray(centres, float), np.array(cell), np.array(part), np.array(lo, float), np.array(hi, float), np.array(n))

    def bounds(self, x: np.ndarray, k: int) -> np.ndarray:
        """For each point a distance within which there are ``k`` members: that of a pivot and of its k-th member from it."""
        last = np.full(len(self.centres), np.inf)
        for c in np.unique(self.cell):
            at = np.flatnonzero(self.cell == c)  # by part
            enough = np.flatnonzero(np.cumsum(self.n[at]) >= k)
            last[c] = self.hi[at[enough[0]]] if len(enough) else np.inf
        return np.concatenate([(_distances(x[i:i + SLICE], self.centres) + last).min(axis=1) for i in range(0, len(x), SLICE)])

    def needs(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The blocks that may hold something within the bound of one of the points."""
        need = np.zeros(len(self.cell), bool)
        for first in range(0, len(x), 256):
            d = _distances(x[first:first + 256], self.centres)[:, self.cell]
            room = bound[first:first + 256] * (1 + _SLACK) + _SLACK
            need |= (np.maximum(self.lo - d, d - self.hi) <= room[:, None]).any(axis=0)
        return np.flatnonzero(need)


BLOCK = "block int, n int, rep binary, x binary, more binary"


def pack(chunked: DataFrame, layout: Layout, more: list[str]) -> DataFrame:
    """One row per block: ids, vectors (in half the bytes where that loses nothing) and other numbers of its rows."""
    held = chunked.sparkSession.sparkContext.broadcast({p: i for i, p in enumerate(zip(layout.cell.tolist(), layout.part.tolist()))})

    def packed(key, group):
        x = np.stack(group["x"].to_numpy()).astype(float)
        with np.errstate(over="ignore"):
            half = x.astype(np.float32)
        x = half if np.array_equal(half.astype(float), x) else x
        other = np.ascontiguousarray(group[more].to_numpy(dtype=float))
        return pd.DataFrame({"block": [held.value[int(key[0]), int(key[1])]], "n": [len(group)], "rep": [group["rep"].fillna(np.iinfo(np.int64).min).to_numpy(dtype=np.int64).tobytes()],
                             "x": [x.tobytes()], "more": [other.tobytes()]})

    return cut_lineage(chunked.select("cell", "part", "rep", "x", *more).groupBy("cell", "part").applyInPandas(packed, BLOCK))


def _unpacked(n: int, rep: bytes, x: bytes, more: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.float32 if len(x) == 4 * n * width else np.float64
    return np.frombuffer(rep, np.int64), np.frombuffer(x, kind).reshape(n, width).astype(float), np.frombuffer(more, float).reshape(n, -1)


# ---- meetings ------------------------------------------------------------------------------------

@dataclass
class Plan:
    """(block, task) of the query blocks and of the member blocks, and the number of tasks."""

    queries: DataFrame
    members: DataFrame
    tasks: int


def plan(queries: DataFrame, asking: Layout, layout: Layout, bound: Callable[[Layout, np.ndarray], np.ndarray]) -> Plan:
    """Which member blocks (of ``layout``) each group of query blocks (of ``asking``) has to see."""
    spark, width = queries.sparkSession, layout.centres.shape[1]
    held = spark.sparkContext.broadcast(layout)
    size = min(GROUP_ROWS, GROUP_BYTES // (8 * width), -(-int(asking.n.sum()) // GROUPS))
    group_of = (np.cumsum(asking.n) - asking.n) // max(size, int(asking.n.max()), 1)

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, *row in _rows(batches, "block", "n", "rep", "x", "more"):
            x = _unpacked(*row, width)[1]
            found = held.value.needs(x, bound(held.value, x))
            yield pa.RecordBatch.from_pydict({"group": pa.array([group_of[block]] * len(found), pa.int32()), "block": pa.array(found, pa.int32())})

    wanted = cut_lineage(_few(queries).mapInArrow(needs, "group int, block int").distinct())
    sizes = F.broadcast(spark.createDataFrame(list(enumerate(layout.n.tolist())), "block int, n long"))
    load = wanted.join(sizes, "block").groupBy("group").agg(F.sum("n").alias("n")).collect()  # one row per group
    lanes, tasks, first = {}, 0, {}
    for group, n in sorted(map(tuple, load)):
        lanes[group], first[group] = -(-n // LANE_ROWS), tasks
        tasks += lanes[group]
    groups = spark.createDataFrame([(g, first[g], lanes[g]) for g in lanes], "group int, first int, lanes int")
    members = wanted.join(F.broadcast(groups), "group").select("block", (F.col("first") + F.pmod(F.hash("block"), F.col("lanes"))).alias("task"))
    blocks = [(b, first[g] + lane) for b, g in enumerate(group_of.tolist()) if g in lanes for lane in range(lanes[g])]
    return Plan(spark.createDataFrame(blocks, "block int, task int"), cut_lineage(members), tasks)


def _few(blocks: DataFrame) -> DataFrame:
    """Blocks are large rows of which some make an Arrow batch, and much work for each: spread evenly."""
    spark = blocks.sparkSession
    return blocks.repartition(max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block")


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(c) for c in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def meet(queries: DataFrame, members: DataFrame, where: Plan, layout: Layout, visitor: Callable[..., object], schema: str) -> DataFrame:
    """What the visitors of all tasks give: ``visitor(layout, reps, x, more)`` for the queries, ``meet`` with each member block, then ``finish``."""
    if not where.tasks:
        return queries.sparkSession.createDataFrame([], schema)
    width, held = layout.centres.shape[1], queries.sparkSession.sparkContext.broadcast(layout)
    side = lambda blocks, tasks, kind: blocks.join(lookup(tasks), "block").select("task", F.lit(kind).alias("kind"), *(c.split()[0] for c in BLOCK.split(", ")))
    both = side(queries, where.queries, 0).unionByName(side(members, where.members, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asks, visit = None, [], None
        for task, kind, block, *row in _rows(batches, "task", "kind", "block", "n", "rep", "x", "more"):
            if task != now:
                if visit:
                    yield from visit.finish()
                now, asks, visit = task, [], None
            if kind == 0:
                asks.append(_unpacked(*row, width))
                continue
            if visit is None:
                visit = visitor(held.value, *(np.concatenate(c) for c in zip(*asks)))
            yield from visit.meet(block, *_unpacked(*row, width))
        if visit:
            yield from visit.finish()

    spread = both.repartitionById(where.tasks, F.col("task")).sortWithinPartitions("task", "kind", "block")
    return spread.mapInArrow(run, schema)


class Visitor:
    """The points of a group, and which of them have to look at a block."""

    def __init__(self, layout: Layout, reps: np.ndarray, x: np.ndarray, limit: np.ndarray):
        self.layout, self.reps, self.x, self.limit = layout, reps, x, limit
        self.norms = (x ** 2).sum(axis=1)

    def slices(self, block: int) -> Iterator[np.ndarray]:
        """Places of the points whose bound reaches the ring of a block, some at a time."""
        away = _distances(self.x, self.layout.centres[self.layout.cell[block]][None])[:, 0]
        room = self.limit * (1 + _SLACK) + _SLACK
        rows = np.flatnonzero(np.maximum(self.layout.lo[block] - away, away - self.layout.hi[block]) <= room)
        for first in range(0, len(rows), SLICE):
            yield rows[first:first + SLICE]

    def within(self, rows: np.ndarray, x: np.ndarray, nearest: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the point, place of the member, exact distance or, where it is surely less than the limit, nothing exact) within the points' limits.

        One matrix product tells most pairs apart; a limit that is still open is the ``nearest``-th of this block.
        """
        q, norms = self.x[rows], (x ** 2).sum(axis=1)
        square = norms[None] - 2 * (q @ x.T)
        most = self.limit[rows] ** 2 - self.norms[rows]
        if 0 < nearest <= len(x) and np.isinf(most).any():
            open_ = np.flatnonzero(np.isinf(most))
            most[open_] = np.partition(square[open_], nearest - 1, axis=1)[:, nearest - 1]
        slack = 1e-10 * (self.norms[rows] + norms.max(initial=0.0) + np.where(np.isfinite(self.limit[rows]), self.limit[rows], 0.0) ** 2)
        i, j = np.nonzero(~(square > (most + slack)[:, None]))  # also where numbers are too large for squares
        sure = square[i, j] < (most - slack)[i]
        return i, j, sure


# ---- nearest members -----------------------------------------------------------------------------

class Nearest(Visitor):
    """The ``k`` nearest members by (distance, rep), with the members' other numbers."""

    def __init__(self, k: int, layout: Layout, reps: np.ndarray, x: np.ndarray, more: np.ndarray):
        super().__init__(layout, reps, x, layout.bounds(x, k))
        self.k, self.best, self.found, self.waiting = k, None, [], 0

    def meet(self, block: int, reps: np.ndarray, x: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
        for rows in self.slices(block):
            i, j, _ = self.within(rows, x, self.k)
            d = _pair_distances(self.x[rows], x, i, j)
            keep = ~(d > (self.limit[rows] * (1 + _SLACK) + _SLACK)[i])
            i, j, d = i[keep], j[keep], d[keep]
            self.found.append((rows[i], d, reps[j], *more[j].T))
            self.waiting += len(d)
            if self.waiting > max(PAIRS, len(self.x)):
                self._merge()
        return iter(())

    def _merge(self) -> None:
        parts = self.found if self.best is None else [self.best, *self.found]
        columns = [np.concatenate(c) for c in zip(*parts)]
        order = np.lexsort((columns[2], columns[1], columns[0]))
        row = columns[0][order]
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
        order = order[place < self.k]
        self.best, self.found, self.waiting = tuple(c[order] for c in columns), [], 0
        last = place[place < self.k] == self.k - 1
        at = self.best[0][last]
        self.limit[at] = np.fmin(self.limit[at], self.best[1][last])

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            self._merge()
        if self.best is None:
            return
        row, d, rep, *more = self.best
        for first in range(0, len(row), OUT):
            part = slice(first, first + OUT)
            yield pa.RecordBatch.from_arrays([pa.array(v[part]) for v in (self.reps[row], rep, d, *more)],
                                             ["qrep", "rep", "distance", *(f"more{c}" for c in range(len(more)))])


def nearest(queries: DataFrame, asking: Layout, members: DataFrame, layout: Layout, k: int, more: int = 0) -> DataFrame:
    """(qrep, rep, distance, more0, ...): the k nearest members of each point by (distance, rep), once or more of each lane."""
    where = plan(queries, asking, layout, lambda at, x: at.bounds(x, k))
    schema = "qrep bigint, rep bigint, distance double" + "".join(f", more{c} double" for c in range(more))
    return meet(queries, members, where, layout, lambda *group: Nearest(k, *group), schema)
