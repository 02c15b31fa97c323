"""Helpers shared by the operators: staged tables, text buffers, mixing of 64-bit values."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.session import scratch, shared_dir

U64 = np.uint64
#: Stands for a null id where a join or a flat file needs a value.
NO_ID = -(1 << 63)


def stage(df: DataFrame, name: str, *folders: str, **options) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    ``folders`` are columns with a folder for each value, so that a filter on them reads nothing else.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path, partitionBy=list(folders) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the folders of a staged table that nothing reads any more."""
    spark, below = df.sparkSession, f"{shared_dir(df.sparkSession).rstrip('/')}/gridlens/"
    for folder in {re.sub("/[^/]*$|(/[^/=]*=[^/]*)+/[^/]*$", "", f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(below).toUri().getPath()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``, whatever other columns are called."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_key(docs: DataFrame) -> list[Column]:
    """Two columns that tell rows apart except equal ones, whose results are equal too; neither is null."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("_row"),
    ]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the offsets where each begins (one more at the end); null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (multiply and fold twice)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def byte_table(seed: int) -> np.ndarray:
    """256 odd 64-bit values derived from the seed."""
    return mix(np.arange(1, 257, dtype=U64) * U64(2 * seed + 1) + U64(seed)) | U64(1)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64."""
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)
