"""Jump consistent hashing: stable keys to shards without a table of the ring.

The shard is a function of the hash of ``doc_id`` and the number of shards alone. When a shard is appended, only the share of rows that
belongs to it moves, and all of these move into it. Places inside a shard (slots) have no gap: rows are numbered inside small
sub-buckets of a shard, whose starts are prefix sums of their counts, so no task orders a whole shard.

A null id hashes like any value; equal ids go to the same shard; null texts are empty (size 1). Repeated rows get slots of their own.
Texts of any length count whole. An empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.llm.common import shuffle_width, stage

#: Fixed values of the published jump hash: the multiplier of its generator and the bits that it divides by.
MULTIPLIER, BITS = 2862933555777941757, 31


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 64-bit keys; each round advances the keys that still jump, about ln(shards) rounds."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    at, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    with np.errstate(over="ignore"):
        while True:
            live = np.flatnonzero(ahead < shards)
            if not len(live):
                return at
            at[live] = ahead[live]
            state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
            draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1
            ahead[live] = ((at[live] + 1) * (float(1 << BITS) / draw)).astype(np.int64)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a column of ids."""

    @F.pandas_udf("int")
    def run(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(np.int64), shards).astype(np.int32))

    return run(F.xxhash64(key.cast("string")))


def assign(docs: DataFrame, shards: int = 8, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and the shard if there were one more (grown_shard)."""
    spark = docs.sparkSession
    n = buckets or max(64, 4 * shuffle_width(spark))
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
    )
    rows = rows.select(
        "*", shard_of(F.col("doc_id"), shards).alias("shard"), shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("_sub"),
    )
    rows = stage(rows, "sharded")  # sub-buckets hold the row's place in the scan, so they must not be made twice
    counts = rows.groupBy("shard", "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_sub").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32")
    numbered = rows.withColumn("_k", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "_sub"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_base") + F.col("_k") - 1).cast("long").alias("slot"), "grown_shard",
    )
