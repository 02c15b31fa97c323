"""Novelty scores: a model fitted and stored on one table scores another.

Local outlier factor: the model keeps, for every trained row, its distance to the k-th neighbour and its local reachability
density, in cells around pivots that are cut into rings of bounded size. A new row finds its exact k nearest trained rows
by pivots and rings (its bound, and the nearest found so far, rule out most others where the data allow it) and takes the
densities along with them. Of equal trained vectors only the k smallest ids can be among the nearest, so no more are kept; equal
new vectors are one question. Trained rows are never compared with all pairs of new ones in one task.

One-class and mixture models keep a mean in kernel space, or weights, means and covariances; and the score that the wanted share of trained rows
lies beyond.

Rows whose vector is null, holds a null, NaN or infinity, or hasn't the model's number of elements aren't trained on; their score is
null and they are no outliers. A model of an empty table (or, for the local outlier factor, of one row) gives null scores. Other columns
stay as they are, except that ``score`` and ``novel`` are replaced. Ids of trained rows are unique.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.operators import anomaly, meeting, neighbors, ordered
from gridlens.operators.neighbors import CHUNK
from gridlens.operators.quantiles import column_quantiles
from gridlens.operators.vector_index import whole_vectors
from gridlens.session import cut_lineage


def _write_numbers(spark: SparkSession, path: str, numbers: dict) -> None:
    spark.createDataFrame([(json.dumps(numbers),)], "numbers string").coalesce(1).write.mode("overwrite").parquet(f"{path}/fitted")


def _read_numbers(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/fitted").first()[0])


# ---- local outlier factor ------------------------------------------------------------------------

def fit_lof(df: DataFrame, row_id: str, features: str, k: int, path: str, share: float = 0.1, seed: int = 42,
            pivots: int | None = None, chunk: int = CHUNK) -> None:
    """Store the model of the whole vectors of a table below ``path``; ``share`` of the trained rows are beyond its limit."""
    spark = df.sparkSession
    rows = cut_lineage(whole_vectors(df, row_id, features))
    near = cut_lineage(neighbors.knn(rows, "id", "x", k, seed))
    far = near.groupBy("id").agg(F.max("distance").alias("k_distance"))
    reach = near.join(far.withColumnRenamed("id", "neighbor"), "neighbor").select("id", F.greatest("distance", "k_distance").alias("reach"))
    density = cut_lineage(far.join(reach.groupBy("id").agg((F.count(F.lit(1)) / (F.sum("reach") + 1e-10 * F.count(F.lit(1)))).alias("lrd")), "id"))
    key = F.sha2(F.to_json(F.struct("x")), 256)
    numbered = ordered.scan(rows.select("id", key.alias("key")), ["key"], ["id"], [ordered.row_number("copy")])
    kept = numbered.where(F.col("copy") <= k).select("id").join(rows, "id").join(density, "id")
    kept = cut_lineage(kept.select(F.col("id").alias("rep"), "x", "k_distance", "lrd"))
    total, width = kept.count(), rows.agg(F.max(F.size("x"))).first()[0] or 0
    if total == 0:
        return _write_numbers(spark, path, {"k": k, "width": 0, "centres": [], "cells": [], "limit": None})
    centres = neighbors._pivots(kept, pivots or max(1, min(2048, total // max(1, chunk // 4))), seed)

    placed = meeting.homes(kept, centres, "rep bigint, x array<double>, k_distance double, lrd double")
    meeting.chunks(placed, chunk).write.mode("overwrite").parquet(f"{path}/members")
    meeting.rings(spark.read.parquet(f"{path}/members")).write.mode("overwrite").parquet(f"{path}/rings")
    cells = spark.read.parquet(f"{path}/rings").groupBy("cell").agg(F.min("lo"), F.max("hi")).collect()  # at most 2048
    trained = neighbors.local_outlier_factor(near, k)
    limit = column_quantiles(trained, ["lof"], [1 - share])["lof"][0]
    _write_numbers(spark, path, {"k": k, "width": width, "centres": centres.tolist(), "cells": sorted(map(tuple, cells)), "limit": limit})


def score_lof(df: DataFrame, features: str, path: str, load: int = 4 * CHUNK) -> DataFrame:
    """The rows with ``score``, their local outlier factor among the trained rows (near 1: as dense as its neighbours), and ``novel``."""
    spark, numbers = df.sparkSession, _read_numbers(df.sparkSession, path)
    rest = df.drop("score", "novel")
    if not numbers["width"]:
        return rest.withColumn("score", F.lit(None).cast("double")).withColumn("novel", F.lit(False))
    k, limit = numbers["k"], numbers["limit"]
    key = F.sha2(F.to_json(F.struct(F.col(features).cast("array<double>").alias("x"))), 256)
    asked = whole_vectors(df.select(F.lit(0).alias("none"), features), "none", features, numbers["width"])
    asked = asked.groupBy(F.sha2(F.to_json(F.struct("x")), 256).alias("key")).agg(F.first("x").alias("x"))
    found = _nearest(spark, cut_lineage(asked.withColumn("rep", F.monotonically_increasing_id())), path, numbers, k, load)
    lrd = F.count(F.lit(1)) / (F.sum(F.greatest("distance", "k_distance")) + 1e-10 * F.count(F.lit(1)))
    scores = found.groupBy("key").agg((F.avg("lrd") / lrd).alias("score"))
    scored = rest.withColumn("__key", key).join(scores.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
    return scored.select(*rest.columns, "score", F.coalesce(F.col("score") > F.lit(limit), F.lit(False)).alias("novel"))


def _nearest(spark: SparkSession, asked: DataFrame, path: str, numbers: dict, k: int, load: int) -> DataFrame:
    """(key, distance, rep, k_distance, lrd) of the exact k nearest members of each question (key, rep, x), by distance and id; a block holds ``load`` questions."""
    members, centres = spark.read.parquet(f"{path}/members"), np.array(numbers["centres"], dtype=float)
    layout = meeting.Layout.of(spark.read.parquet(f"{path}/rings"), centres)
    chunked = meeting.chunks(meeting.homes(asked.select("rep", "x"), centres, "rep bigint, x array<double>"), load)
    if not chunked.take(1):
        return spark.createDataFrame([], "key string, distance double, rep bigint, k_distance double, lrd double")
    asking = meeting.Layout.of(meeting.rings(chunked), centres)
    found = meeting.nearest(meeting.pack(chunked, asking, []), asking, meeting.pack(members, layout, ["k_distance", "lrd"]), layout, k, more=2)
    named = asked.select("key", F.col("rep").alias("qrep")).join(found, "qrep")
    return _first(named.select("key", "distance", "rep", F.col("more0").alias("k_distance"), F.col("more1").alias("lrd")), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key").orderBy("distance", "rep"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


# ---- one-class kernel rule and Gaussian mixture ------------------------------------------------------

def fit_one_class(df: DataFrame, row_id: str, features: str, path: str, share: float = 0.1, gamma: float | None = None, seed: int = 42) -> None:
    """Store the mean of a table in the space of a radial kernel and the similarity that ``share`` of its rows stay below."""
    rows = cut_lineage(whole_vectors(df, row_id, features))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    numbers = {"kind": "one_class", "width": width, "gamma": gamma, "seed": seed, "mean": [], "limit": None}
    if width:
        lifted = rows.select(anomaly.fourier_features("x", width, gamma=gamma, seed=seed).alias("z"))
        numbers["mean"] = lifted.select(Summarizer.mean(anomaly._vector("z")).alias("m")).first()["m"].toArray().tolist()
    _limited(df.sparkSession, rows, path, numbers, share)


def fit_mixture(df: DataFrame, row_id: str, features: str, path: str, components: int = 2, share: float = 0.1, seed: int = 42) -> None:
    """Store a Gaussian mixture of a table and the log likelihood that ``share`` of its rows stay below."""
    from pyspark.ml.clustering import GaussianMixture

    rows = cut_lineage(whole_vectors(df, row_id, features))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    numbers = {"kind": "mixture", "width": width, "parts": [], "limit": None}
    if width:
        model = GaussianMixture(featuresCol="v", k=components, seed=seed, maxIter=50).fit(rows.select(anomaly._vector("x").alias("v")))
        numbers["parts"] = [(float(w), g.mean.toArray().tolist(), g.cov.toArray().tolist()) for w, g in zip(model.weights, model.gaussians)]
    _limited(df.sparkSession, rows, path, numbers, share)


def _limited(spark: SparkSession, rows: DataFrame, path: str, numbers: dict, share: float) -> None:
    if numbers["width"]:
        numbers["limit"] = column_quantiles(rows.select(_usual("x", numbers).alias("score")), ["score"], [share])["score"][0]
    _write_numbers(spark, path, numbers)


def _usual(features: str, numbers: dict) -> Column:
    """How usual a vector is: its similarity to the kernel mean, or its log likelihood."""
    width = numbers["width"]
    if numbers["kind"] == "one_class":
        lifted = anomaly.fourier_features(features, width, gamma=numbers["gamma"], seed=numbers["seed"])
        mean = F.array(*[F.lit(v) for v in numbers["mean"]])
        return F.aggregate(F.zip_with(lifted, mean, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    parts = []
    for weight, mean, cov in numbers["parts"]:
        norm = np.log(max(weight, 1e-300)) - 0.5 * (width * np.log(2 * np.pi) + np.linalg.slogdet(np.array(cov))[1])
        parts.append(F.lit(float(norm)) - 0.5 * anomaly.mahalanobis(features, np.array(mean), np.linalg.pinv(np.array(cov))))
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return top + F.log(sum((F.exp(p - top) for p in parts), F.lit(0.0)))


def score_usual(df: DataFrame, features: str, path: str) -> DataFrame:
    """The rows with ``score``, how usual they are under a stored one-class or mixture model, and ``novel``, below its limit."""
    numbers = _read_numbers(df.sparkSession, path)
    rest = df.drop("score", "novel")
    if not numbers["width"]:
        return rest.withColumn("score", F.lit(None).cast("double")).withColumn("novel", F.lit(False))
    x, width = F.col(features).cast("array<double>"), numbers["width"]
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    whole = F.coalesce((F.size(x) == width) & ~F.exists(x, odd), F.lit(False))
    # Vectors that aren't whole are scored as zeros, and the score is dropped.
    usable = rest.withColumn("__whole", whole).withColumn("__x", F.when(whole, x).otherwise(F.array_repeat(F.lit(0.0), width)))
    scored = usable.withColumn("__score", _usual("__x", numbers)).withColumn("score", F.when(F.col("__whole"), F.col("__score")))
    return scored.select(*rest.columns, "score", F.coalesce(F.col("score") < F.lit(numbers["limit"]), F.lit(False)).alias("novel"))
