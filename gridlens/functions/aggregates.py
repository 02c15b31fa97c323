"""Aggregate expressions that are safe on constant columns under ANSI rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlens.functions.scalar import col


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over rows where both are known; null where either is constant."""
    x, y = col(a).cast("double"), col(b).cast("double")
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
