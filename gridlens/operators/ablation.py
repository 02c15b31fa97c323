"""Ablation of the isolation-forest detector over scaling, projection, selection and contamination."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.scalar import ratio
from gridlens.operators import anomaly, encode, selection
from gridlens.operators.evaluate import roc_auc


def binary_measures(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of 0/1 columns in one aggregate."""
    both = F.count(F.when((F.col(truth) == 1) & (F.col(predicted) == 1), 1))
    given, real = F.sum(F.col(predicted)), F.sum(F.col(truth))
    return df.agg(
        F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"), ratio(both, given).alias("precision"),
        ratio(both, real).alias("recall"), ratio(2 * both, given + real).alias("f1"),
    )


def run(df: DataFrame, row_id: str, columns: list[str], truth: str, configs: dict[str, dict]) -> DataFrame:
    """One row of AUC, F1, accuracy, precision and recall per configuration, best F1 first.

    A configuration may set ``scale`` (minmax, zscore, robust), ``select`` (columns of highest mutual information),
    ``pca`` (components), ``contamination`` and ``trees``.
    """
    rows = []
    for name, config in configs.items():
        chosen, part = list(columns), df
        if config.get("scale"):
            part = encode.scale(part, encode.scale_params(part, chosen, config["scale"]))
        if config.get("select"):
            chosen = selection.k_best(selection.mutual_information(part, chosen, truth), "mutual_information", config["select"])
        part = part.select(row_id, truth, F.array(*[F.col(c).cast("double") for c in chosen]).alias("x"))
        if config.get("pca"):
            vectors = part.withColumn("v", array_to_vector("x"))
            model, _, _ = selection.pca(vectors, "v", k=config["pca"], width=len(chosen))
            part = model.transform(vectors).select(row_id, truth, vector_to_array("components").alias("x"))
        forest = anomaly.isolation_forest(part, row_id, "x", trees=config.get("trees", 50))
        scored = anomaly.isolation_score(part, forest, "x").select(truth, "score")
        flagged = anomaly.flag_share(scored, "score", config.get("contamination", 0.1))
        flagged = flagged.withColumn("predicted", F.col("anomaly").cast("int"))
        m = binary_measures(flagged, truth, "predicted").first()
        auc = roc_auc(flagged, truth, "score").first()["auc"]
        rows.append((name, *[None if v is None else float(v) for v in (auc, m["f1"], m["accuracy"], m["precision"], m["recall"])]))
    rows.sort(key=lambda r: (-r[2], r[0]))
    return df.sparkSession.createDataFrame(rows, "config string, auc double, f1 double, accuracy double, precision double, recall double")
