"""Encoding and scaling with one global dictionary and global statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.scalar import col
from gridlens.operators import ordered
from gridlens.operators.clean import replace_columns
from gridlens.operators.quantiles import agg_row, column_quantiles
from gridlens.session import lookup


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct non-null values with 0-based codes in sorted order."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return ordered.scan(values, [], ["value"], [ordered.row_number("rn")]).select(
        "value", (F.col("rn") - 1).cast("bigint").alias("code")
    )


def encode_with(df: DataFrame, column: str, codes: DataFrame, name: str, missing: int | None = None) -> DataFrame:
    """Attach codes from a dictionary; unknown and null values get ``missing``.

    A small dictionary is broadcast by its counted size, a large one is joined by shuffle, where
    skewed values are split at run time.
    """
    joined = df.join(lookup(codes.select(F.col("value").alias("__v"), F.col("code").alias(name))), F.col(column) == F.col("__v"), "left")
    code = F.col(name) if missing is None else F.coalesce(F.col(name), F.lit(missing))
    return joined.select(*df.columns, code.cast("bigint").alias(name))


def label_encode(df: DataFrame, column: str, name: str, null_text: str | None = None) -> DataFrame:
    """Codes by sorted order of the values; nulls become ``null_text`` first if given."""
    if null_text is not None:
        df = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(null_text)))
    return encode_with(df, column, dictionary(df, column), name)


def label_decode(df: DataFrame, column: str, codes: DataFrame, name: str) -> DataFrame:
    joined = df.join(lookup(codes.select(F.col("code").alias("__k"), F.col("value").alias(name))), F.col(column) == F.col("__k"), "left")
    return joined.select(*df.columns, name)


def category_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """As :func:`label_encode`, with -1 for null."""
    return encode_with(df, column, dictionary(df, column), name, missing=-1)


def factorize(df: DataFrame, column: str, row_id: str, name: str) -> DataFrame:
    """Codes by first appearance in ``row_id`` order."""
    seen = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(row_id).alias("first_row"))
    codes = ordered.scan(seen, [], ["first_row"], [ordered.row_number("rn")])
    return encode_with(df, column, codes.select("value", (F.col("rn") - 1).alias("code")), name, missing=-1)


def one_hot(df: DataFrame, column: str, values: list, prefix: str | None = None) -> DataFrame:
    """0/1 columns for the stated values. Pass the training values so that later data gets the same columns."""
    prefix = column if prefix is None else prefix
    flags = [F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values]
    return df.select("*", *flags)


def categories(df: DataFrame, column: str, limit: int = 10_000) -> list:
    """Sorted distinct values for :func:`one_hot`; more than ``limit`` is refused, never cut off."""
    found = df.where(F.col(column).isNotNull()).select(column).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} values: use ordinal codes instead of one column each")
    return sorted(r[0] for r in found)


def encoding_plan(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """``ordinal`` for 2 to 10 distinct values, else ``onehot``."""
    counts = agg_row(df, {c: F.count_distinct(c) for c in columns}, batch=10)
    return {c: "ordinal" if 2 <= counts[c] <= 10 else "onehot" for c in columns}


def encoder_pipeline(df: DataFrame, columns: list[str]):
    """ML pipeline by :func:`encoding_plan`; unseen values get their own index, or a zero vector."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    stages = []
    for c, kind in encoding_plan(df, columns).items():
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="alphabetAsc"))
        if kind == "onehot":
            stages.append(OneHotEncoder(inputCols=[f"{c}_index"], outputCols=[f"{c}_onehot"], handleInvalid="keep", dropLast=True))
    return Pipeline(stages=stages)


def scale_params(df: DataFrame, columns: list[str], method: str) -> dict[str, tuple[float, float]]:
    """(shift, divisor) per column for minmax, zscore (population deviation) or robust scaling.

    A constant column gets divisor 0 for minmax (its result is 0) and 1 for the others.
    """
    if method == "robust":
        found = column_quantiles(df, columns, [0.25, 0.5, 0.75])
        return {c: (q[1] or 0.0, ((q[2] or 0.0) - (q[0] or 0.0)) or 1.0) for c, q in found.items()}
    low, spread = {"minmax": (F.min, lambda c: F.max(c) - F.min(c)), "zscore": (F.avg, F.stddev_pop)}[method]
    row = agg_row(df, {**{("a", c): low(c) for c in columns}, **{("b", c): spread(c) for c in columns}})
    other = 0.0 if method == "minmax" else 1.0
    return {c: (float(row[("a", c)] or 0.0), float(row[("b", c)] or other)) for c in columns}


def scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    def scaled(c, shift, divisor):
        if divisor == 0:
            return F.when(F.col(c).isNotNull(), F.lit(0.0))
        return (F.col(c).cast("double") - F.lit(shift)) / F.lit(divisor)

    return replace_columns(df, {c: scaled(c, *p) for c, p in params.items()})


def unscale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return replace_columns(df, {c: F.col(c) * F.lit(d) + F.lit(s) for c, (s, d) in params.items()})


def hash_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 hex digest of each value; null stays null."""
    return replace_columns(df, {c: F.sha2(col(c).cast("string"), 256) for c in columns})
