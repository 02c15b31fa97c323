"""A corpus pipeline: quality filter, line dedup, near-duplicate removal, benchmark decontamination, packing into training sequences.

``STAGES`` holds (name, function) pairs. Each function takes (spark, docs, sf_dir), with ``docs`` what the stage before has kept, and returns a
DataFrame; all but the last return the columns of ``docs``. ``run`` applies them in turn to ``documents``, and writes each result below the
shared folder before the next stage reads it, so every stage works on whole, settled tables. Empty tables pass through all stages; null texts are
empty documents; rows with a null doc_id stay unless a stage drops them for what they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm import decontaminate, lines, packing, quality, simhash
from gridlens.llm.common import stage


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of 0.5 or more)."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = quality.train(quality.learn_rows(docs, labels))
    columns = docs.columns
    scored = quality.score(docs, model)
    return scored.filter(F.col(f"`{scored.columns[-1]}`") >= 0.5).select(*[F.col(f"`{c}`") for c in columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates."""
    return lines.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows don't contaminate."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    return packing.pack(docs, "byte_bpe_50k.json", 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packed),
]

#: No SQL: the trained classifier and the packing can't be said in it; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
