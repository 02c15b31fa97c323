"""Fitted models on requests and streams: versioned bundles, and a stream that takes a newer one between its batches.

A bundle (model, feature names, labels) is written whole below ``<path>/version-<n>`` before its number is entered in ``<path>/versions``, so
a reader never meets half a model. A scored micro-batch first notes which version it takes; run again after a failure it takes the
same one and replaces its own rows.

A request is a row with an array of numbers in the order of the model's features. One that is null, empty, has a null or
NaN, or another number of elements is kept with the reason in ``reject`` and without a result. ``reject``, ``predicted`` and ``confidence`` (and
``version`` in streams) replace columns of those names; all others stay, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.operators import models
from gridlens.operators.rules import vector_error
from gridlens.streaming.streams import BatchTable

RESULTS = ("version", "reject", "predicted", "confidence")


class ModelStore:
    """Versions of a model bundle below a shared folder; one publisher at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.loaded = spark, path, {}

    def newest(self) -> int:
        """The highest number entered, 0 if there is none."""
        try:
            return self.spark.read.schema("version int").json(f"{self.path}/versions").agg(F.max("version")).first()[0] or 0
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return 0

    def publish(self, model: PipelineModel, features: list[str], labels: list[str]) -> int:
        version = self.newest() + 1
        models.save_bundle(f"{self.path}/version-{version}", model, features, labels, self.spark)
        self.spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").json(f"{self.path}/versions")
        return version

    def load(self, version: int) -> tuple[PipelineModel, list[str], list[str]]:
        """A bundle; the latest one loaded is held."""
        if version not in self.loaded:
            self.loaded = {version: models.load_bundle(f"{self.path}/version-{version}", self.spark)}
        return self.loaded[version]


def score_requests(requests: DataFrame, features: str, bundle: tuple[PipelineModel, list[str], list[str]]) -> DataFrame:
    """The rows with ``reject``, ``predicted`` (a label) and ``confidence`` (its probability), in one pass."""
    model, names, labels = bundle
    rest = [c for c in requests.columns if c not in RESULTS[1:]]
    x, width = F.col(features).cast("array<double>"), len(names)
    marked = requests.select(F.struct(*rest).alias("__row"), vector_error(x, width).alias("__reject"), x.alias("__x"))
    # Rejected rows run through the model as zeros, and their result is dropped.
    usable = F.when(F.col("__reject").isNull(), F.col("__x")).otherwise(F.array_repeat(F.lit(0.0), width))
    spread = marked.select("__row", "__reject", usable.alias("__x")).select("__row", "__reject", *[F.col("__x")[i].alias(n) for i, n in enumerate(names)])
    scored = model.transform(spread)
    good = F.col("__reject").isNull()
    label = F.array(*[F.lit(v) for v in labels])[F.col("prediction").cast("int")]
    return scored.select("__row.*", F.col("__reject").alias("reject"), F.when(good, label).alias("predicted"),
                         F.when(good, F.array_max(vector_to_array("probability"))).alias("confidence"))


def scoring_sink(store: ModelStore, path: str, features: str, schema: T.StructType) -> tuple[BatchTable, Callable[[DataFrame, int], None]]:
    """(scored rows, per-batch function): each micro-batch is scored by the newest version there is when it first runs."""
    names = [f for f in schema.fields if f.name not in RESULTS]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    table = BatchTable(f"{path}/scored", f"{kept}, version int, reject string, predicted string, confidence double")
    taken = BatchTable(f"{path}/taken", "version int")

    def each(batch_rows: DataFrame, batch: int) -> None:
        spark = batch_rows.sparkSession
        try:
            noted = taken.own(spark, batch).first()
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            noted = None
        version = noted[0] if noted else store.newest()
        if not version:
            raise ValueError(f"no model has been published below {store.path}")
        if not noted:
            taken.write(spark.createDataFrame([(version,)], "version int").coalesce(1), batch)
        rows = batch_rows.select(*[f.name for f in names])
        scored = score_requests(rows, features, store.load(version))
        table.write(scored.withColumn("version", F.lit(version)), batch)

    return table, each
