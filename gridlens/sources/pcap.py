"""Packets of capture files, and the state of each file.

The files are read by the ``capture`` source (sources/capture.py), each byte range once, into a stored table. Where ranges of a file don't agree on
a border, the later one had taken payload for a record header: only such ranges are read again, from the border. Records are decoded by column expressions (functions/frames.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.functions.frames import decode_packets
from gridlens.session import LOOKUP_ROWS, scratch
from gridlens.sources.capture import ETHERNET, HEADER, RECORD, SCHEMA, SPLIT_BYTES, CaptureSource, read_range
from gridlens.sources.files import file_system

__all__ = ["ETHERNET", "HEADER", "RECORD", "create", "packets", "packet_stream", "read_captures", "read_ranges"]

PATTERN = "*.pcap,*.pcapng"


def create(path: str):
    """A new binary file at a path as Spark names it; missing folders are made."""
    system, inner = file_system(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _disagreeing(held: DataFrame) -> DataFrame:
    """(path, border, ranges): runs of ranges that don't begin where the records before them end, with the place where those of the first run's range do."""
    ranges = held.filter("status IS NOT NULL").select("path", "range_start", "range_stop", F.col("offset").alias("first"), "next")
    by_place = Window.partitionBy("path").orderBy("range_start")
    border = F.max("next").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    inside = F.col("border") < F.col("range_stop")
    wrong = (F.col("border") >= F.col("range_start")) & F.when(inside, ~F.col("first").eqNullSafe(F.col("border"))).otherwise(F.col("first").isNotNull())
    marked = ranges.withColumn("border", border).withColumn("wrong", F.coalesce(wrong, F.lit(False)))
    begins = F.col("wrong") & ~F.coalesce(F.lag("wrong").over(by_place), F.lit(False))
    marked = marked.withColumn("begins", begins).withColumn("run", F.count_if("begins").over(by_place)).filter("wrong")
    runs = F.sort_array(F.collect_list(F.struct("range_start", "range_stop"))).alias("ranges")
    return marked.groupBy("path", "run").agg(F.min("border").alias("border"), runs).select("path", "border", "ranges")


def read_ranges(spark: SparkSession, folder: str, pattern: str = PATTERN, split: int = SPLIT_BYTES) -> DataFrame:
    """Rows of the ``capture`` source (packets, and a row with a status per range), stored, with all ranges in agreement."""
    spark.dataSource.register(CaptureSource)
    held = _stored(spark.read.format("capture").option("pattern", pattern).option("splitBytes", split).load(folder), "captures")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, inner = file_system(r["path"])
                size, at = system.get_file_info(inner).size, r["border"]
                for part in r["ranges"]:  # one after the other, as each ends where the next one begins
                    for rows in read_range(r["path"], size, part["range_start"], part["range_stop"], at):
                        yield rows
                    at = rows.column("next")[-1].as_py()

    while True:
        wrong = _stored(_disagreeing(held), "capture-borders")
        n = wrong.count()
        if not n:
            return held
        spread = wrong.repartition(min(n, spark.sparkContext.defaultParallelism * 4), "path", "border")
        mended = _stored(spread.mapInArrow(again, SCHEMA), "captures-again")
        keys = _stored(wrong.select("path", F.explode("ranges.range_start").alias("range_start")), "capture-ranges")
        rest = held.join(F.broadcast(keys) if keys.count() <= LOOKUP_ROWS else keys, ["path", "range_start"], "left_anti")
        held = rest.select(*held.columns).unionByName(mended)


def packets(rows: DataFrame) -> DataFrame:
    """Decoded packets of rows of the ``capture`` source, from a table or a stream; (path, offset) is unique."""
    kept = rows.filter("status IS NULL").select("path", "offset", "ts_us", "length", "data")
    return decode_packets(kept).withColumn("ts", F.timestamp_micros("ts_us").cast("timestamp_ntz"))


def packet_stream(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """Decoded packets of the captures that arrive in a folder; a file is taken once, whole."""
    spark.dataSource.register(CaptureSource)
    return packets(spark.readStream.format("capture").option("pattern", pattern).load(folder))


def read_captures(spark: SparkSession, folder: str, pattern: str = PATTERN, split: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(packets, files): decoded packets, and each file with its status ok, partial or failed and the first error."""
    held = read_ranges(spark, folder, pattern, split)
    worst = F.max(F.when(F.col("status") == "failed", 2).when(F.col("status") == "partial", 1).otherwise(0))
    errors = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("range_start")))
    files = held.filter("status IS NOT NULL").groupBy("path").agg(worst.alias("w"), errors.alias("error")).select(
        "path", F.element_at(F.array(F.lit("ok"), F.lit("partial"), F.lit("failed")), F.col("w") + 1).alias("status"), "error")
    return packets(held), files
