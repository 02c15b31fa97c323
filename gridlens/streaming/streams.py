"""Structured Streaming versions of the live rules.

Event time has a watermark of ten minutes unless stated. Windows are emitted once (append),
counters as they change (update). Stateful per-source rules run on each micro-batch as joins with
a small written table, so one busy source is never the work of a single task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions.scalar import severity_band
from gridlens.operators.rules import auto_block

DELAY = "10 minutes"


def packet_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 1000,
                  ts: str = "ts", delay: str | None = DELAY) -> DataFrame:
    """A file stream with its time column as a timestamp under a watermark."""
    raw = (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )
    timed = raw.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed if delay is None else timed.withWatermark(ts, delay)


def source_counts(stream: DataFrame, source: str, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """Packets per source and window."""
    return stream.groupBy(F.window(ts, width).alias("w"), source).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), source, "n")


def violation_rate(stream: DataFrame, violation: Column, correct: Column, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """Violations, their share and the accuracy of a rule per tumbling window."""
    return stream.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(violation.cast("int")).alias("violations"),
        F.avg(violation.cast("double")).alias("rate"), F.avg(correct.cast("double")).alias("accuracy"),
    ).select(F.col("w.start").alias("window_start"), "n", "violations", "rate", "accuracy")


def session_counts(stream: DataFrame, source: str, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions per source as the stream sees them."""
    return stream.groupBy(F.session_window(ts, gap).alias("w"), source).agg(F.count(F.lit(1)).alias("n")).select(
        source, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def without_repeats(stream: DataFrame, packet_id: str) -> DataFrame:
    """Drop packets seen before within the watermark."""
    return stream.dropDuplicatesWithinWatermark([packet_id])


def alerts(stream: DataFrame, confidence: Column, threshold: float = 0.5) -> DataFrame:
    """Scored rows above the threshold with their band."""
    return stream.withColumn("confidence", confidence).where(F.col("confidence") > threshold).withColumn(
        "band", severity_band("confidence"))


def run_available(stream: DataFrame, checkpoint: str, mode: str = "append", path: str | None = None,
                  each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what is there now, to a Parquet folder or by a function per micro-batch, and stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


class BatchTable:
    """A table below a shared folder with one sub-folder per micro-batch.

    A batch that is run again replaces its own sub-folder, and reads only those before it, so a
    replay after a failure gives the same result.
    """

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path, schema

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        return self.read(spark).where(F.col("batch") < batch).drop("batch")

    def own(self, spark: SparkSession, batch: int) -> DataFrame:
        """One batch, from its own sub-folder only."""
        return spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch}")

    def last(self, spark: SparkSession, below: int | None = None) -> DataFrame:
        """The newest batch, or the newest below a number: the one before it is tried first, so that no folder list is needed."""
        if below is not None:
            try:
                return self.own(spark, below - 1).withColumn("batch", F.lit(below - 1).cast("bigint"))
            except Exception as error:
                if "PATH_NOT_FOUND" not in str(error):
                    raise
        rows = self.read(spark)
        rows = rows if below is None else rows.where(F.col("batch") < below)
        newest_batch = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == F.lit(newest_batch).cast("bigint"))

    def read(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(f"{self.schema}, batch bigint").option("basePath", self.path).parquet(self.path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], f"{self.schema}, batch bigint")


def upserted(path: str, schema: str) -> tuple[BatchTable, Callable[[DataFrame, int], None]]:
    """A sink for update mode: the changed rows of every batch; the newest batch of a key holds."""
    table = BatchTable(path, schema)
    return table, table.write


def newest(table: BatchTable, spark: SparkSession, keys: list[str]) -> DataFrame:
    rows = table.read(spark)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def blocking_sink(path: str, source: str, order: list[str], confidence: str, schema: str, threshold: float = 0.9):
    """(accepted rows, per-batch function): rows up to the first confident alert of their source, later ones skipped.

    The block points so far are one row per blocked source, taken as one more confident row at its old place, so
    the batch rule needs no second form. Each batch writes all of them anew, so a batch reads one folder of its
    predecessor and the work doesn't grow with the number of batches.
    """
    accepted = BatchTable(f"{path}/accepted", f"{schema}, blocks boolean")
    blocks = BatchTable(f"{path}/blocks", schema)

    def each(batch_rows: DataFrame, batch: int) -> None:
        spark = batch_rows.sparkSession
        names = batch_rows.columns
        past = blocks.last(spark, batch).select(*names)
        old = past.withColumn("__old", F.lit(True))
        both = batch_rows.withColumn("__old", F.lit(False)).unionByName(old)
        kept = auto_block(both, source, order, confidence, threshold).where("not __old").drop("__old")
        accepted.write(kept.select(*names, "blocks"), batch)
        blocks.write(past.unionByName(accepted.own(spark, batch).where("blocks").select(*names)), batch)

    return accepted, each


def ring_buffer(path: str, schema: str, order: list[str], n: int = 100):
    """(table, per-batch function): after each batch, its sub-folder holds the n latest rows so far."""
    table = BatchTable(path, schema)

    def each(batch_rows: DataFrame, batch: int) -> None:
        spark = batch_rows.sparkSession
        buffer = table.last(spark, batch).select(*batch_rows.columns)
        latest = buffer.unionByName(batch_rows).orderBy(*[F.desc(o) for o in order]).limit(n)
        table.write(latest, batch)

    return table, each
