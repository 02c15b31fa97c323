"""Column statistics. Each report is one aggregate row over pruned columns, turned to long form at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions.scalar import col, finite, inverse_normal, ratio
from gridlens.operators import ordered
from gridlens.operators.pairwise import correlations
from gridlens.operators.quantiles import agg_row, column_quantiles, group_quantiles


def long_form(df: DataFrame, stats: dict[str, dict[str, Column]], label: str = "column_name", batch: int = 25) -> DataFrame:
    """One row per key of ``stats`` with its named aggregates as columns.

    All aggregates of a batch run in one pass and the single row is spread with an
    inline array of structs, so nothing is collected.
    """
    parts = []
    keys = list(stats)
    for start in range(0, len(keys), batch):
        chosen = keys[start:start + batch]
        aggregates = [e.alias(f"k{i}_{n}") for i, k in enumerate(chosen) for n, e in stats[k].items()]
        rows = F.array(*[
            F.struct(F.lit(k).alias(label), *[F.col(f"k{i}_{n}").alias(n) for n in stats[k]])
            for i, k in enumerate(chosen)
        ])
        parts.append(df.agg(*aggregates).select(F.inline(rows)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_skewness(c: Column | str) -> Column:
    """Bias-corrected skewness (null below three values)."""
    x = col(c).cast("double")
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(c: Column | str) -> Column:
    """Bias-corrected excess kurtosis (null below four values)."""
    x = col(c).cast("double")
    n = F.count(x).cast("double")
    below = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n > 3, (n - 1) / below * ((n + 1) * F.kurtosis(x) + 6))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max per column (quartiles are exact)."""
    quartiles = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    stats = {}
    for c in columns:
        q = [F.lit(v).cast("double") for v in quartiles[c]]
        stats[c] = {
            "n": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(F.col(c).cast("double")),
            "q25": F.max(q[0]), "q50": F.max(q[1]), "q75": F.max(q[2]), "max": F.max(F.col(c).cast("double")),
        }
    return long_form(df, stats)


def advanced_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median, deviation, variance, skewness and excess kurtosis (sample versions)."""
    medians = column_quantiles(df, columns, [0.5])
    return long_form(df, {
        c: {
            "mean": F.avg(c), "median": F.max(F.lit(medians[c][0]).cast("double")), "std": F.stddev_samp(c),
            "variance": F.var_samp(c), "skewness": sample_skewness(c), "kurtosis": sample_kurtosis(c),
        }
        for c in columns
    })


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count and percent per column."""
    total = F.count(F.lit(1))
    return long_form(df, {
        c: {"missing": total - F.count(c), "missing_pct": ratio(total - F.count(c), total) * 100}
        for c in (columns or df.columns)
    })


def distinct_profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column, exact or by a HyperLogLog++ sketch."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return long_form(df, {c: {"n_distinct": count(F.col(c))} for c in (columns or df.columns)}, batch=10)


def binary_columns(df: DataFrame, columns: list[str] | None = None, zero_one: bool = False) -> list[str]:
    """Columns with exactly two distinct values (of 0 and 1 only, if asked), without counting distincts.

    Two plain passes do: the extremes, then whether every value is one of them.
    """
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    ends = agg_row(df, {(tag, c): fn(c) for c in columns for tag, fn in (("lo", F.min), ("hi", F.max))})
    varied = [c for c in columns if ends[("lo", c)] is not None and ends[("lo", c)] != ends[("hi", c)]]
    if zero_one:
        varied = [c for c in varied if ends[("lo", c)] == 0 and ends[("hi", c)] == 1]
    if not varied:
        return []
    only = agg_row(df, {c: F.bool_and(F.col(c).isin(ends[("lo", c)], ends[("hi", c)])) for c in varied})
    return [c for c in varied if only[c]]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows; copies meet map-side before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
    )


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows per value; the k most frequent (value order on ties) if asked."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts if k is None else counts.orderBy(F.desc("n"), F.asc(column)).limit(k)


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and share per class. The total is the sum of the class counts, not a second scan."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.withColumn("share", ratio("n", F.lit(total)))


def data_profile(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """One row per column: rows, missing, distinct, and moments for numeric columns."""
    # Distinct counts expand each row per column, so they stay apart from the moments.
    total = F.count(F.lit(1))
    none = F.max(F.lit(None).cast("double"))
    medians = column_quantiles(df, numeric, [0.5]) if numeric else {}
    stats = {}
    for c in numeric + text:
        x = F.col(c)
        is_number = c in medians
        stats[c] = {
            "kind": F.max(F.lit("numeric" if is_number else "text")),
            "n": total, "missing": total - F.count(x),
            "mean": F.avg(x) if is_number else none,
            "median": F.max(F.lit(medians[c][0]).cast("double")) if is_number else none,
            "std": F.stddev_samp(x) if is_number else none,
            "skewness": sample_skewness(x) if is_number else none,
        }
    return long_form(df, stats, batch=10).join(distinct_profile(df, numeric + text), "column_name")


def pattern_summary(df: DataFrame, by: list[str], source: str, severity: str, size: str) -> DataFrame:
    """Per group: distinct sources, the first 100 of them in order, mean and population deviation.

    The source list is the 100 smallest by rank over distinct pairs, so no group's full
    set of sources is gathered.
    """
    numbers = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(severity).alias("severity_mean"), F.stddev_pop(severity).alias("severity_std"),
        F.avg(size).alias("size_mean"), F.stddev_pop(size).alias("size_std"),
    )
    pairs = df.where(F.col(source).isNotNull()).select(*by, source).distinct()
    counts = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sources"))
    ranked = ordered.scan(pairs, by, [source], [ordered.row_number("rn")]).where("rn <= 100")
    lists = ranked.groupBy(*by).agg(
        F.array_join(F.array_sort(F.collect_list(source)).cast("array<string>"), ",").alias("first_sources")
    )
    return numbers.join(counts, by, "left").join(lists, by, "left")


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each ordered pair, long form. The upper triangle is computed once."""
    found = {}
    for (a, b), r in correlations(df, columns).items():
        found[(a, b)] = found[(b, a)] = r
    varied = agg_row(df, {c: F.var_pop(c) for c in columns})
    rows = [
        (a, b, (1.0 if varied[a] else None) if a == b else found[(a, b)]) for a in columns for b in columns
    ]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, corr double")


def top_variance(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    return long_form(df, {c: {"variance": F.var_samp(c)} for c in columns}).orderBy(
        F.desc("variance"), "column_name"
    ).limit(k)


def box_stats(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends (outermost values inside the fences) and rows beyond them."""
    stats = {}
    none = F.max(F.lit(None).cast("double"))
    for c, (q1, q2, q3) in column_quantiles(df, columns, [0.25, 0.5, 0.75]).items():
        if q1 is None:  # a column without values
            stats[c] = {"q1": none, "median": none, "q3": none, "whisker_low": none, "whisker_high": none, "n_outside": F.count(F.lit(None))}
            continue
        low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
        x = F.col(c).cast("double")
        stats[c] = {
            "q1": F.max(F.lit(q1)), "median": F.max(F.lit(q2)), "q3": F.max(F.lit(q3)),
            "whisker_low": F.min(F.when(x >= low, x)), "whisker_high": F.max(F.when(x <= high, x)),
            "n_outside": F.count(F.when((x < low) | (x > high), 1)),
        }
    return long_form(df, stats)


def iqr_outliers(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Outlier count and percent per column."""
    stats = {}
    for c, (q1, q3) in column_quantiles(df, columns, [0.25, 0.75]).items():
        if q1 is None:  # a column without values
            stats[c] = {"n_outliers": F.count(F.lit(None)), "outlier_pct": ratio(F.count(F.lit(None)), F.count(c)) * 100}
            continue
        low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
        beyond = F.count(F.when((F.col(c) < low) | (F.col(c) > high), 1))
        stats[c] = {"n_outliers": beyond, "outlier_pct": ratio(beyond, F.count(c)) * 100}
    return long_form(df, stats)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between the extremes; the last bin includes its upper end; empty bins show as 0."""
    ends = agg_row(df, {"lo": F.min(column), "hi": F.max(column)})
    if ends["lo"] is None:  # a column without values: no edges, no counts
        return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.lit(None).cast("double").alias("bin_low"), F.lit(0).cast("bigint").alias("n"))
    lo, hi = float(ends["lo"]), float(ends["hi"])
    width = (hi - lo) / bins
    place = F.lit(0) if width == 0 else F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
    counts = df.where(F.col(column).isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("bin_low"), F.coalesce("n", F.lit(0)).alias("n")
    )


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value against the normal quantile of its mean plotting position (rank - 0.5) / n.

    Equal values collapse to one counted row before they are ranked.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    upto = ordered.scan(counts, [], ["value"], [ordered.running("upto", "sum", "n")])
    total = df.agg(F.count(column)).first()[0]
    position = (F.col("upto") - F.col("n") / 2.0) / float(max(total, 1))
    return upto.select("value", "n", inverse_normal(position).alias("normal_quantile"))


def normality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Jarque-Bera statistic and p-value (chi-squared, two degrees) from population moments."""
    stats = {}
    for c in columns:
        jb = F.count(c) / 6.0 * (F.pow(F.skewness(c), 2) + F.pow(F.kurtosis(c), 2) / 4.0)
        stats[c] = {"n": F.count(c), "jarque_bera": jb, "p_value": F.exp(-jb / 2.0)}
    return long_form(df, stats)


def ks_normality(df: DataFrame, column: str) -> DataFrame:
    """Kolmogorov-Smirnov distance to the normal with the sample's mean and deviation."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    moments = agg_row(df, {"m": F.avg(column), "s": F.stddev_samp(column)})
    sample = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    found = KolmogorovSmirnovTest.test(sample, "x", "norm", moments["m"], moments["s"])
    return found.select("statistic", F.col("pValue").alias("p_value"))


def welch_density(df: DataFrame, order: list, value: str, segment: int = 256) -> DataFrame:
    """Mean one-sided periodogram of Hann-windowed segments with half overlap (unit sampling rate).

    Rows get their place in time order, each row goes to the one or two segments that
    cover it, and each segment is one bounded group for the transform.
    """
    import numpy as np
    import pandas as pd

    step = segment // 2
    placed = ordered.scan(df.select("*", F.col(value).cast("double").alias("__x")), [], order, [ordered.row_number("__rn")])
    place = F.col("__rn") - 1
    total = df.count()
    last = max((total - segment) // step, -1)
    first = F.greatest(F.floor((place - segment) / step) + 1, F.lit(0))
    final = F.least(F.floor(place / step), F.lit(last))
    members = placed.where(first <= final).select(
        F.explode(F.sequence(first.cast("bigint"), final.cast("bigint"))).alias("segment"), place.alias("place"), "__x"
    )
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    scale = 1.0 / (window ** 2).sum()

    def periodogram(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values("place")["__x"].to_numpy()
        power = np.abs(np.fft.rfft((x - x.mean()) * window)) ** 2 * scale
        power[1:-1] *= 2
        return pd.DataFrame({"bin": np.arange(power.size), "power": power})

    per_segment = members.groupBy("segment").applyInPandas(periodogram, "bin int, power double")
    return per_segment.groupBy("bin").agg(F.avg("power").alias("power"), F.count(F.lit(1)).alias("n_segments")).withColumn(
        "frequency", F.col("bin") / float(segment)
    )


def activity(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Records per hour, day …"""
    return df.groupBy(F.date_trunc(unit, ts).cast("timestamp_ntz").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def peak_buckets(counts: DataFrame, k: int = 10, spread: float = 2.0) -> DataFrame:
    """Buckets with a count above mean + 2 sample deviations, the k largest."""
    m = agg_row(counts, {"mean": F.avg("n"), "std": F.stddev_samp("n")})
    threshold = (m["mean"] or 0.0) + spread * (m["std"] or 0.0)
    return (
        counts.where(F.col("n") > threshold).orderBy(F.desc("n"), "bucket").limit(k)
        .withColumn("mean_n", F.lit(m["mean"])).withColumn("threshold", F.lit(threshold))
    )


def rate_by(df: DataFrame, by: str, flag: Column) -> DataFrame:
    """Share of rows with the flag per group."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag.cast("int")).cast("bigint").alias("n_true"),
        F.avg(flag.cast("double")).alias("rate"),
    )


def crosstab(df: DataFrame, row: str, flag: str, values: list) -> DataFrame:
    """Counts of each value of ``flag`` per ``row`` as columns; the values are stated, so no extra job runs."""
    pivoted = df.groupBy(row).pivot(flag, values).agg(F.count(F.lit(1)))
    return pivoted.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"{flag}_{v}") for v in values])


def batch_rate(df: DataFrame, order: list, flag: Column, size: int = 1000) -> DataFrame:
    """Share of flagged rows in each run of ``size`` rows in order."""
    rows = df.select("*", flag.cast("int").alias("__flag"))
    placed = ordered.scan(rows, [], order, [ordered.row_number("__rn")])
    return placed.groupBy(F.floor((F.col("__rn") - 1) / size).cast("bigint").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__flag").cast("bigint").alias("n_true"),
        (F.sum("__flag") / F.count(F.lit(1))).alias("rate"),
    )


def row_stats(features: Column | str) -> dict[str, Column]:
    """Mean, population deviation, min and max over the elements of an array column."""
    x = col(features).cast("array<double>")
    n = F.size(x).cast("double")
    add = lambda a, b: a + b
    mean = F.aggregate(x, F.lit(0.0), add) / n
    square = F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), add) / n
    return {
        "row_mean": mean,
        "row_std": F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))),
        "row_min": F.array_min(x),
        "row_max": F.array_max(x),
    }
