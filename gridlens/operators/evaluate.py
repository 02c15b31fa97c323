"""Evaluation of predictions: counts first, then small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.scalar import ratio
from gridlens.operators import ordered
from gridlens.operators.quantiles import agg_row, column_quantiles


def canonical_label(c):
    """One text form for labels stored as whole numbers, doubles or text, so that "0" equals "0.0"."""
    text = F.trim(F.col(c).cast("string"))
    return F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    hit = F.col(truth).eqNullSafe(F.col(predicted))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~hit, 1)).alias("misclassified"), F.avg(hit.cast("double")).alias("accuracy")
    )


def _cells(df, truth, predicted):
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, limit: int = 1_000_000) -> DataFrame:
    """All label pairs, zero cells included; more than ``limit`` different pairs are refused."""
    rows = _cells(df, truth, predicted).limit(limit + 1).collect()  # at most classes squared
    if len(rows) > limit:
        raise ValueError(f"{truth} and {predicted} have more than {limit} pairs: they are no classes")
    labels = sorted({r[0] for r in rows} | {r[1] for r in rows})
    seen = {(r[0], r[1]): r[2] for r in rows}
    kind = df.schema[truth].dataType.simpleString()
    return df.sparkSession.createDataFrame(
        [(a, b, seen.get((a, b), 0)) for a in labels for b in labels], f"truth {kind}, predicted {kind}, n bigint"
    )


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class plus macro and weighted averages; 0 where undefined."""
    cells = _cells(df, truth, predicted).select(
        F.inline(F.array(
            F.struct(F.col("truth").cast("string").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("given"),
                     F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0).cast("bigint")).alias("hit")),
            F.struct(F.col("predicted").cast("string").alias("class"), F.lit(0).cast("bigint").alias("support"),
                     F.col("n").alias("given"), F.lit(0).cast("bigint").alias("hit")),
        ))
    )
    sums = cells.groupBy("class").agg(F.sum("support").alias("support"), F.sum("given").alias("given"), F.sum("hit").alias("hit"))
    p, r = ratio("hit", "given"), ratio("hit", "support")
    per_class = sums.select("class", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")
    macro = per_class.agg(*[F.avg(m).alias(m) for m in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    weighted = per_class.agg(*[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in ("precision", "recall", "f1")],
                             F.sum("support").alias("support"))
    return per_class.unionByName(macro.select(F.lit("macro").alias("class"), "*")).unionByName(
        weighted.select(F.lit("weighted").alias("class"), "*"))


def roc_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Threshold, true and false positive rate for each distinct score, highest first. Equal scores are one point."""
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.count(F.when(F.col(truth) == 1, 1)).alias("p"), F.count(F.when(F.col(truth) != 1, 1)).alias("n"))
    total = counts.agg(F.sum("p"), F.sum("n")).first()
    run = ordered.scan(counts, [], [F.desc("threshold")], [ordered.running("tp", "sum", "p"), ordered.running("fp", "sum", "n")])
    return run.select("threshold", "p", "n", "tp", "fp",
                      ratio("tp", F.lit(total[0])).alias("tpr"), ratio("fp", F.lit(total[1])).alias("fpr"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Exact area under the ROC curve by trapezoids over distinct scores."""
    # tp and fp are running sums, so the point before is tp - p and fp - n: no second window.
    points = roc_points(df, truth, score)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0))
    return points.agg(F.max("tp").alias("n_pos"), F.max("fp").alias("n_neg"), area.alias("a")).select(
        "n_pos", "n_neg", F.try_divide(F.col("a"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def pr_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Precision, recall and F1 when rows scored at or above each distinct score are called positive."""
    p = ratio("tp", F.col("tp") + F.col("fp"))
    return roc_points(df, truth, score).select("threshold", p.alias("precision"), F.col("tpr").alias("recall"),
                                               ratio(2 * p * F.col("tpr"), p + F.col("tpr")).alias("f1"))


def threshold_search(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Threshold table for low scores = anomaly: 50 percentiles (5 to 40) judged by F1, 30 by 0.7 F1 + 0.3 (TPR - FPR).

    ``chosen`` marks the first best one, F1 thresholds first. All counts come from one pass.
    """
    grid = [("f1", 5 + 35 * i / 49) for i in range(50)] + [("f1_j", 5 + 35 * i / 29) for i in range(30)]
    probs = sorted({p / 100 for _, p in grid})
    at = dict(zip(probs, column_quantiles(df, [score], probs)[score]))
    wanted = {"pos": F.count(F.when(F.col(truth) == 1, 1)), "n": F.count(F.lit(1))}
    for p in probs:
        low = F.col(score) < F.lit(at[p])
        wanted[("tp", p)] = F.count(F.when(low & (F.col(truth) == 1), 1))
        wanted[("all", p)] = F.count(F.when(low, 1))
    seen = agg_row(df, wanted)
    rows, best = [], (0.0, None)
    for i, (method, percent) in enumerate(grid):
        p = percent / 100
        tp, given, pos, n = seen[("tp", p)], seen[("all", p)], seen["pos"], seen["n"]
        f1 = 2 * tp / (given + pos) if given + pos else 0.0
        youden = tp / (pos + 1e-8) - (given - tp) / (n - pos + 1e-8)
        value = f1 if method == "f1" else 0.7 * f1 + 0.3 * youden
        if 0 < given < n and value > best[0]:
            best = (value, i)
        rows.append([method, float(percent), float(at[p]), float(f1), float(youden), float(value)])
    return df.sparkSession.createDataFrame(
        [(*r, i == best[1]) for i, r in enumerate(rows)],
        "method string, percent double, threshold double, f1 double, youden double, value double, chosen boolean",
    )
