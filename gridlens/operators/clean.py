"""Cleaning and imputation. Statistics are always of the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions.scalar import clip, finite, to_number
from gridlens.operators.profile import sample_skewness
from gridlens.operators.quantiles import agg_row, column_quantiles


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


def clean_infinite(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities become null. Run this before any statistic."""
    return replace_columns(df, {c: finite(c) for c in columns})


def coerce_numeric(df: DataFrame, columns: list[str], default: float | None = None) -> DataFrame:
    """Text columns to double; stray text becomes null or the default."""
    return replace_columns(df, {c: to_number(c, default) for c in columns})


def drop_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value."""
    counts = agg_row(df, {c: F.count(F.col(f"`{c}`")) for c in df.columns})
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] > 0])


def column_modes(df: DataFrame, columns: list[str]) -> dict:
    """Most frequent value of each column, the smallest on a tie; counts are combined map-side."""
    modes = {}
    for c in columns:
        top = (
            df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("v")).limit(1).collect()
        )
        modes[c] = top[0]["v"] if top else None
    return modes


def fill_values(df: DataFrame, columns: list[str], strategy: str, constant=0.0) -> dict:
    """One fill value per column for mean, median, mode, constant or adaptive.

    ``adaptive`` takes the median where the absolute skewness is above 1, else the mean.
    """
    if strategy == "constant":
        return {c: constant for c in columns}
    if strategy == "mode":
        return column_modes(df, columns)
    if strategy == "mean":
        return agg_row(df, {c: F.avg(c) for c in columns})
    if strategy == "median":
        return {c: q[0] for c, q in column_quantiles(df, columns, [0.5]).items()}
    if strategy == "adaptive":
        stats = agg_row(df, {**{("m", c): F.avg(c) for c in columns}, **{("s", c): sample_skewness(c) for c in columns}})
        skewed = [c for c in columns if stats[("s", c)] is not None and abs(stats[("s", c)]) > 1]
        fills = {c: stats[("m", c)] for c in columns}
        if skewed:
            fills.update({c: q[0] for c, q in column_quantiles(df, skewed, [0.5]).items()})
        return fills
    raise ValueError(f"unknown strategy {strategy!r}")


def impute(df: DataFrame, columns: list[str], strategy: str = "mean", constant=0.0) -> DataFrame:
    fills = fill_values(df, columns, strategy, constant)
    return replace_columns(df, {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items() if v is not None})


def clip_fixed(df: DataFrame, columns: list[str], bound: float = 1e6) -> DataFrame:
    return replace_columns(df, {c: clip(c, -bound, bound) for c in columns})


def iqr_fences(df: DataFrame, columns: list[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    """Lower and upper fence per column, from exact quartiles."""
    fences = {}
    for c, (q1, q3) in column_quantiles(df, columns, [0.25, 0.75]).items():
        if q1 is not None:
            fences[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return fences


def iqr_clip(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    return replace_columns(df, {c: clip(c, lo, hi) for c, (lo, hi) in iqr_fences(df, columns, factor).items()})


def iqr_filter(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Keep rows that lie inside the fences in every column; a null is no outlier."""
    keep = F.lit(True)
    for c, (lo, hi) in iqr_fences(df, columns, factor).items():
        keep = keep & (F.col(c).isNull() | F.col(c).between(lo, hi))
    return df.where(keep)


# The whole-number types from narrow to wide with their bounds.
_WHOLE = (("byte", 2**7), ("short", 2**15), ("int", 2**31), ("long", 2**63))


def downcast_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Narrowest type that holds the observed range; fractional columns go to float where it is exact."""
    wanted, kinds = {}, {f.name: f.dataType for f in df.schema}
    for c in columns:
        wanted[("lo", c)], wanted[("hi", c)] = F.min(c), F.max(c)
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            wanted[("fit", c)] = F.bool_and(F.col(c).cast("float").cast("double") == F.col(c))
    seen = agg_row(df, wanted)
    types = {}
    for c in columns:
        lo, hi = seen[("lo", c)], seen[("hi", c)]
        if lo is None:
            continue
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            types[c] = "float" if seen[("fit", c)] else "double"
        else:
            types[c] = next(name for name, bound in _WHOLE if -bound <= lo and hi < bound)
    return types


def downcast(df: DataFrame, columns: list[str]) -> DataFrame:
    return replace_columns(df, {c: F.col(c).cast(t) for c, t in downcast_types(df, columns).items()})


def robust_clean(df: DataFrame, columns: list[str], width: int | None = None) -> DataFrame:
    """Infinities to null, median fill (0 where a column is empty), fence clip, then pad or trim to ``width``."""
    cleaned = clean_infinite(df, columns)
    fills = {c: (0.0 if v is None else v) for c, v in fill_values(cleaned, columns, "median").items()}
    filled = replace_columns(cleaned, {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})
    clipped = iqr_clip(filled, columns)
    if width is None:
        return clipped
    others = [c for c in df.columns if c not in columns]
    padding = [F.lit(0.0).alias(f"pad_{i}") for i in range(len(columns), width)]
    return clipped.select(*others, *columns[:width], *padding)
