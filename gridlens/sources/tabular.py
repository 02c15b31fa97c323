"""CSV, folder, JSON and Parquet sources and sinks."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions.names import sanitise
from gridlens.functions.scalar import folder_label


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Pass a schema; inference reads the data twice and is for exploration."""
    reader = spark.read.option("header", True)
    if schema is None:
        # Names come from the header line itself: the reader would number those that differ in case only.
        header = spark.read.csv(path).first()
        return reader.option("inferSchema", True).csv(path).toDF(*sanitise([h or "" for h in header]))
    return reader.schema(schema).csv(path)


def file_headers(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(source_path, header) of all matching files below a folder; the header of a file that can't be read, or has no line, is null.

    Only the first block of each file is looked at, and its lines come in order, so the first of them is the header.
    """
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    files = found.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("source_path"), "length")
    text = found.option("ignoreCorruptFiles", True).text(path)
    first = text.where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("source_path"), "value", F.monotonically_increasing_id().alias("at"))
    first = first.groupBy("source_path").agg(F.min_by("value", "at").alias("header"))
    return files.where("length > 0").select("source_path").join(first, "source_path", "left")


def read_folder(spark: SparkSession, path: str, schema: str, pattern: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """All matching files below a folder as (rows, rejects), with the file of each row as ``source_path``.

    Columns are bound by the names in each file's own header, whatever their order; columns that the schema doesn't name are left out and
    missing ones are null. Files with the same header are read together. A line is a reject if a value doesn't fit its column's type; each
    is read as text and converted here, so that the verdict does not depend on the columns asked for. A file that can't be read is a reject
    without a line.
    """
    fields = T.StructType.fromDDL(schema).fields
    names = [f.name for f in fields]
    heads = file_headers(spark, path, pattern).collect()  # a row per file, as the reader's own listing
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in heads:
        if row.header is not None:
            groups.setdefault(tuple(x.strip() for x in next(csv.reader([row.header.lstrip("\ufeff")]), [])), []).append(row.source_path)
    raw = spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in [*names, "source_path"]]))
    for header, paths in groups.items():
        columns = [T.StructField(n if n in names and n not in header[:i] else f"_other_{i}", T.StringType()) for i, n in enumerate(header)]
        part = spark.read.option("header", True).option("ignoreCorruptFiles", True).schema(T.StructType(columns)).csv(paths)
        part = part.select(*[F.col(f"`{n}`") if n in header else F.lit(None).cast("string").alias(n) for n in names], F.col("_metadata.file_path").alias("source_path"))
        raw = raw.unionByName(part)
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in fields}
    bad = F.lit(False)
    for f in fields:
        bad = bad | (F.col(f"`{f.name}`").isNotNull() & typed[f.name].isNull())
    good = raw.where(~bad).select(*[c.alias(n) for n, c in typed.items()], "source_path")
    line = F.concat_ws(",", *[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names])
    unread = spark.createDataFrame([(None, r.source_path) for r in heads if r.header is None], "line string, source_path string")
    return good, raw.where(bad).select(line.alias("line"), "source_path").unionByName(unread)


def with_folder_label(df: DataFrame, name: str = "attack_type", skip: int = 4) -> DataFrame:
    """The class label from the folder that holds each row's file."""
    return df.withColumn(name, folder_label("source_path", skip))


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def land_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Land a table as Parquet, by default split by nothing; partition by a column of few values."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
