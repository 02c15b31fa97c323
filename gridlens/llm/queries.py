"""The registered queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm import centroids, centroids_sql, chat, decontaminate, fingerprint, lexical, lexical_sql, lines, mixing, mixing_sql, packing, quality, sharding, simhash, suffixes, tokenfile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 1024).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op8_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read(tokenfile.write(table(spark, sf_dir, "documents"), "word_bpe_49k.json"))


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(quality.learn_rows(docs, table(spark, sf_dir, "labels")))
    scored = quality.score(docs.select("doc_id", "text"), model, ["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(quality.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_benchmark_decontamination", decontaminate.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op4_line_templates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dropped(table(spark, sf_dir, "documents"))
    return rows.select("_held.doc_id", F.col("_lines.n").cast("long").alias("n_lines"), F.col("_lines.out").cast("long").alias("n_dropped"), F.col("_lines.text").alias("text"))


@query("op7_locally_consistent_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


@query("op6_preference_pairs", chat.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pairs = chat.preference_pairs(turns.select("conv_id", "turn", "role", "text"), chat.mismatched(turns), "conv_id")
    return pairs.select("conv_id", "n_shared", "prompt", "chosen", "rejected", chat.listed("chosen_spans").alias("chosen_spans"), chat.listed("rejected_spans").alias("rejected_spans"))


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"), 200).drop("text")


@query("op11_centroid_clustering", centroids_sql.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed=2)
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


@query("op12_source_mixing", mixing_sql.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), limit=3).select("doc_id", "size", "source_size", "target", "taken")


@query("op13_lexical_search", lexical_sql.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10).select("item_id", "rank", "doc_id", "score")
