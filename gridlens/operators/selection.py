"""Feature selection and reduction from mergeable statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.aggregates import correlation
from gridlens.operators.profile import long_form
from gridlens.operators.pairwise import correlations
from gridlens.operators.quantiles import agg_row, column_quantiles


def variance_filter(df: DataFrame, columns: list[str], threshold: float = 0.01, relative: bool = False) -> DataFrame:
    """Population variance per column and whether it is above the threshold (or threshold x mean variance)."""
    found = agg_row(df, {c: F.var_pop(c) for c in columns})
    values = [found[c] or 0.0 for c in columns]
    cut = threshold * (sum(values) / len(values)) if relative else threshold
    return df.sparkSession.createDataFrame(
        [(c, float(v), v > cut) for c, v in zip(columns, values)], "column_name string, variance double, kept boolean"
    )


def correlation_prune(df: DataFrame, columns: list[str], threshold: float = 0.9) -> list[str]:
    """Columns to drop: those whose absolute correlation with any earlier column is above the threshold.

    Only the k x k matrix reaches the driver.
    """
    corr = correlations(df, columns)
    return [b for j, b in enumerate(columns) if any(abs(corr[(a, b)] or 0.0) > threshold for a in columns[:j])]


def anova_f(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """One-way ANOVA F per column, from count, mean and variance per class."""
    rows = df.where(F.col(label).isNotNull())
    moments = rows.groupBy(label).agg(
        *[e for i, c in enumerate(columns) for e in (
            F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.coalesce(F.var_samp(c), F.lit(0.0)).alias(f"v{i}"))]
    )
    per_class = moments.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"))
        for i, c in enumerate(columns)
    ]))).where("n > 0")
    total = per_class.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
        F.collect_list(F.struct("n", "m")).alias("classes"),  # one entry per class
    )
    mean = F.col("s") / F.col("n")
    between = F.aggregate("classes", F.lit(0.0), lambda a, c: a + c["n"] * (c["m"] - mean) * (c["m"] - mean))
    f = F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return total.select("column_name", f.alias("f_value"))


def k_best(scores: DataFrame, by: str, k: int) -> list[str]:
    return [r["column_name"] for r in scores.orderBy(F.desc_nulls_last(by), "column_name").limit(k).collect()]


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each column, cut at its exact quantiles, with the label.

    Rows collapse to (column, bin, class) counts map-side; the rest works on that small table.
    """
    probs = [i / bins for i in range(1, bins)]
    edges = {c: sorted(set(q)) for c, q in column_quantiles(df, columns, probs).items()}
    place = lambda c: sum(((F.col(c) > F.lit(e)).cast("int") for e in edges[c]), F.lit(0))
    binned = df.where(F.col(label).isNotNull()).select(
        F.col(label).alias("y"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.when(F.col(c).isNotNull(), place(c)).alias("x")) for c in columns
        ]))
    ).where("x is not null")
    joint = binned.groupBy("column_name", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    by_x = joint.groupBy("column_name", "x").agg(F.sum("n").alias("nx"))
    by_y = joint.groupBy("column_name", "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("column_name").agg(F.sum("n").alias("nt"))
    parts = joint.join(by_x, ["column_name", "x"]).join(by_y, ["column_name", "y"]).join(total, "column_name")
    p = F.col("n") / F.col("nt")
    return parts.groupBy("column_name").agg(
        F.sum(p * F.log(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")))).alias("mutual_information")
    )


def target_correlation(df: DataFrame, columns: list[str], target: str, k: int | None = None) -> DataFrame:
    """Absolute correlation with the target, best first."""
    found = long_form(df, {c: {"abs_corr": F.abs(correlation(c, target))} for c in columns})
    return found if k is None else found.orderBy(F.desc_nulls_last("abs_corr"), "column_name").limit(k)


def above_percentile(scores: dict[str, float], percent: float) -> list[str]:
    """Features whose importance is above the given percentile of all importances."""
    ranked = sorted(scores.values())
    place = (len(ranked) - 1) * percent / 100.0
    low = int(place)
    high = min(low + 1, len(ranked) - 1)
    cut = ranked[low] + (ranked[high] - ranked[low]) * (place - low)
    return [c for c, v in scores.items() if v > cut]


def with_minimum(chosen: list[str], df: DataFrame, columns: list[str], target: str, minimum: int = 10) -> list[str]:
    """Top up a choice of fewer than ``minimum`` features with the ones most correlated with the target."""
    if len(chosen) >= minimum:
        return chosen
    ranked = [r["column_name"] for r in target_correlation(df, columns, target, minimum).collect()]
    return chosen + [c for c in ranked if c not in chosen]


def above_mean(scores: dict[str, float]) -> list[str]:
    mean = sum(scores.values()) / len(scores)
    return [c for c, v in scores.items() if v > mean]


def pca(df: DataFrame, features: str, k: int | None = None, share: float | None = None, width: int | None = None):
    """(model, explained shares, k) for centred data; k from the cumulative variance share if asked.

    Covariance sums are built by executors; only the width x width matrix is solved on the driver.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler

    width = width or len(df.select(features).first()[0])
    full = min(k or width, width)
    centre = StandardScaler(inputCol=features, outputCol="centred", withMean=True, withStd=False)
    model = Pipeline(stages=[centre, PCA(k=full, inputCol="centred", outputCol="components")]).fit(df)
    shares = [float(v) for v in model.stages[-1].explainedVariance]
    if share is not None:
        total, full = 0.0, 0
        for v in shares:
            total, full = total + v, full + 1
            if total >= share - 1e-12:
                break
        centre_model = model.stages[0]
        model = Pipeline(stages=[centre_model, PCA(k=full, inputCol="centred", outputCol="components")]).fit(df)
    return model, shares[:full], full
