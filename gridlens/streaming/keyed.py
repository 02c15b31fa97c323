"""Rules of a live stream that remember something for each source, as keyed state.

The state lives in the state store of the engine: it is committed with each micro-batch, so a batch that is run again finds the state from before it, and lost
executors lose nothing. Timers run on event time and drop what is over, so the state follows the sources that are active and not the age of the stream.

A busy source doesn't make a busy task where its rows can be reduced first: sessions are joined inside each Arrow batch before the shuffle, and no more than the
latest rows of each batch are sent to a ring. Blocks need a source's rows in order; a task holds the rows of one source and micro-batch, and none of a blocked source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_keyed_state(spark: SparkSession) -> SparkSession:
    """Keyed state of several variables needs the store that keeps them in column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


# ---- blocks ------------------------------------------------------------------------------------

class Blocks(StatefulProcessor):
    """Rows of a source up to and with a confident alert; then none until the block is over.

    State: where the block began (time and id of the alert) and when it is over. A row from before the alert that comes late is still
    accepted, and a late alert from before the block moves its beginning there; rows that were accepted are not called back.
    """

    def __init__(self, ts: str, row_id: str, confidence: str, threshold: float, block_s: float | None, columns: list[str]):
        self.ts, self.row_id, self.confidence, self.threshold, self.block_s, self.columns = ts, row_id, confidence, threshold, block_s, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", T.StructType([T.StructField("at", T.LongType()), T.StructField("id", T.LongType()), T.StructField("until", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        block = tuple(self.block.get()) if self.block.exists() else None
        held = [self._open(part, block) for part in rows]
        every, before = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0], block
        at, ids = _micros(every[self.ts]).to_numpy(), every[self.row_id].to_numpy()
        order = np.lexsort((ids, at))
        at, ids, hot = at[order], ids[order], (every[self.confidence] > self.threshold).to_numpy()[order]
        alerts, kept, i = np.flatnonzero(hot), [], 0
        if block is not None:  # what was sent before the block, and what comes after it
            i = self._before(at, ids, block, "left")
            if hot[:i].any():
                block = (int(at[alerts[0]]), int(ids[alerts[0]]), block[2])
                i = self._before(at, ids, block, "right")
            kept.append(np.arange(i))
            i = max(i, int(np.searchsorted(at, block[2])))
        while i < len(at):
            place = int(np.searchsorted(alerts, i))
            if place == len(alerts):
                block = None
                kept.append(np.arange(i, len(at)))
                break
            n = int(alerts[place])
            kept.append(np.arange(i, n + 1))
            block = (int(at[n]), int(ids[n]), int(at[n]) + int(self.block_s * 1e6) if self.block_s is not None else (1 << 63) - 1)
            i = max(n + 1, int(np.searchsorted(at, block[2])))
        if block != before:
            self._keep(before, block)
        if kept:
            kept = np.concatenate(kept)
            yield every[self.columns].iloc[order[kept]].assign(blocks=hot[kept])

    @staticmethod
    def _before(at: np.ndarray, ids: np.ndarray, block, side: str) -> int:
        """Sorted rows that lie before (right: not after) the alert of a block."""
        first, last = (int(np.searchsorted(at, block[0], s)) for s in ("left", "right"))
        return first + int(np.searchsorted(ids[first:last], block[1], side))

    def _open(self, rows: pd.DataFrame, block) -> pd.DataFrame:
        """The rows that a block doesn't take away at once."""
        if block is None:
            return rows
        at = _micros(rows[self.ts])
        return rows[(at <= block[0]) | (at >= block[2])]

    def _keep(self, before, block) -> None:
        if self.block_s is not None and before is not None:
            self.handle.deleteTimer(before[2] // 1000 + 1)
        if block is None:
            self.block.clear()
            return
        self.block.update(block)
        if self.block_s is not None:
            self.handle.registerTimer(block[2] // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.block.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def blocked(stream: DataFrame, source: str, ts: str, row_id: str, confidence: str, threshold: float = 0.9, block_s: float | None = None) -> DataFrame:
    """The accepted rows of a stream, with ``blocks`` for the alert that begins a block.

    A block ends after ``block_s`` seconds of event time, if given. Rows need a time and an id.
    """
    with_keyed_state(stream.sparkSession)
    schema = T.StructType([*stream.schema.fields, T.StructField("blocks", T.BooleanType())])
    processor = Blocks(ts, row_id, confidence, threshold, block_s, stream.columns)
    return stream.groupBy(source).transformWithStateInPandas(processor, schema, "append", "eventtime" if block_s is not None else "none")


# ---- the latest rows -------------------------------------------------------------------------------

class Ring(StatefulProcessor):
    """The ``n`` latest rows of a key. State: a list of them. A batch that changes it gives the rows that are new in it."""

    def __init__(self, order: list[str], n: int, schema: T.StructType):
        self.order, self.n, self.schema = order, n, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        ring = pd.DataFrame(held, columns=names).assign(__new=False)
        for part in rows:  # never more than the ring and one Arrow batch
            part = part[names].assign(__new=True)
            ring = (pd.concat([ring, part]) if len(ring) else part).sort_values(self.order, ascending=False, kind="stable").head(self.n)
        fresh = ring[ring["__new"]]
        if len(fresh):
            self.rows.put([tuple(r) for r in ring[names].itertuples(index=False)])
            yield fresh[names]

    def close(self) -> None:
        pass


def ring(stream: DataFrame, order: list[str], n: int = 100, by: list[str] | None = None, shards: int = 16) -> DataFrame:
    """Rows as they enter the ``n`` latest ones of their key, or without one of their shard (by the last column of ``order``, which must be unique).

    The ring of a key is in the ``n`` latest rows of what comes out, so ``latest`` reads it. No Arrow batch sends more than ``n`` rows of a
    key or shard, so a busy source is reduced before the shuffle, and a key has one ring.
    """
    with_keyed_state(stream.sparkSession)
    keys = list(by) if by else ["__shard"]
    dealt = stream if by else stream.withColumn("__shard", F.pmod(F.xxhash64(order[-1]), F.lit(shards)))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select([*keys, *(o for o in order if o not in keys)]).to_pandas()
            places = rows.sort_values(order, ascending=False, kind="stable").groupby(keys, sort=False, dropna=False).head(n).index
            yield batch.take(pa.array(places, pa.int64()))

    few = dealt.mapInArrow(reduced, dealt.schema)
    return few.groupBy(*keys).transformWithStateInPandas(Ring(order, n, stream.schema), stream.schema, "append", "none")


def latest(rows: DataFrame, order: list[str], n: int = 100, by: list[str] | None = None) -> DataFrame:
    """The ``n`` latest rows, of each key if there is one."""
    down = [F.desc(o) for o in order]
    if not by:
        return rows.orderBy(*down).limit(n)
    from pyspark.sql import Window

    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*down))).filter(F.col("__k") <= n).drop("__k")


# ---- sessions --------------------------------------------------------------------------------------

def joined(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, rows) spans, with those that are less than a gap apart as one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class Sessions(StatefulProcessor):
    """Sessions of a source. State: the open ones as one value; a timer at the first end gives out and drops all that are over by then."""

    def __init__(self, source: str, gap: int):
        self.source, self.gap = source, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("first", "last", "n")]
        self.open = handle.getValueState("open", T.StructType(fields))  # one row: rows of state are passed one by one

    def _spans(self) -> list[tuple[int, int, int]]:
        held = self.open.get()
        return list(zip(*held)) if held else []

    def _put(self, spans: list[tuple[int, int, int]]) -> None:
        self.open.update(tuple(map(list, zip(*spans))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, mark = self._spans(), timerValues.getCurrentWatermarkInMs() * 1000
        spans = before
        for part in rows:
            part = part[part["last"] >= mark]
            spans = joined([*spans, *zip(part["first"].tolist(), part["last"].tolist(), part["n"].tolist())], self.gap)
        if spans != before:
            self._put(spans)
            self._timer(before, spans)
        yield pd.DataFrame()

    def _end(self, span: tuple[int, int, int]) -> int:
        return (span[1] + self.gap) // 1000 + 1  # in milliseconds, not before the end

    def _timer(self, before: list[tuple[int, int, int]], now: list[tuple[int, int, int]]) -> None:
        """One timer a source, whatever the number of its sessions; the first one ends first, as they are in order."""
        old, new = (self._end(spans[0]) if spans else None for spans in (before, now))
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spans, mark = self._spans(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        over = [s for s in spans if self._end(s) < mark]
        left = spans[len(over):]  # in order
        if left:
            self._put(left)
            self.handle.registerTimer(self._end(left[0]))
        else:
            self.open.clear()
        yield pd.DataFrame([(*key, *s) for s in over], columns=[self.source, "first", "last", "n"])

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, source: str, ts: str = "ts", gap_s: float = 1800) -> DataFrame:
    """Closed sessions of each source (source, first, last in microseconds, n), as soon as the watermark has passed their end.

    ``stream`` needs a watermark on ``ts``. Runs of rows that end before it are too late and left out.
    """
    gap = int(gap_s * 1e6)
    kind = stream.schema[source].dataType
    spans = T.StructType([T.StructField(source, kind), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("n", T.LongType())])

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The runs of each source in an Arrow batch, so that a busy source sends few rows."""
        for rows in batches:
            rows = pd.DataFrame({source: rows[source], "at": _micros(rows[ts]), ts: rows[ts]}).sort_values([source, "at"], kind="stable")
            start = (rows[source] != rows[source].shift()) | (rows["at"] - rows["at"].shift() >= gap)
            groups = rows.groupby(start.cumsum().to_numpy(), sort=False)
            yield groups.agg(**{source: (source, "first"), "first": ("at", "first"), "last": ("at", "last"), "n": ("at", "size")})

    with_keyed_state(stream.sparkSession)
    runs = stream.select(source, ts).mapInPandas(reduced, spans)
    return runs.groupBy(source).transformWithStateInPandas(Sessions(source, gap), spans, "append", "eventtime")


def open_sessions(spark: SparkSession, checkpoint: str, source: str) -> DataFrame:
    """The sessions that a stopped or running stream still holds, read from its state."""
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    spans = state.select(F.col(f"key.{source}").alias(source), F.explode(F.arrays_zip("value.first", "value.last", "value.n")).alias("s"))
    return spans.select(source, "s.first", "s.last", "s.n")
