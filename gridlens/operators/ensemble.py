"""Votes over predictions that stand side by side in one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlens.functions.scalar import col


def hard_vote(votes: list[Column | str], needed: int | None = None) -> Column:
    """1 where at least ``needed`` 0/1 votes (default: a majority) are 1."""
    needed = len(votes) // 2 + 1 if needed is None else needed
    return (sum((col(v).cast("int") for v in votes), F.lit(0)) >= needed).cast("int")


def rounded_vote(votes: list[Column | str]) -> Column:
    """Rounded mean of class numbers, halves to even."""
    return F.bround(sum((col(v).cast("double") for v in votes), F.lit(0.0)) / len(votes)).cast("int")


def soft_vote(probabilities: list[Column | str], weights: list[float] | None = None) -> Column:
    """Weighted mean of probability arrays, element by element."""
    weights = weights or [1.0] * len(probabilities)
    scaled = [F.transform(col(p), _times(w / sum(weights))) for p, w in zip(probabilities, weights)]
    total = scaled[0]
    for part in scaled[1:]:
        total = F.zip_with(total, part, lambda a, b: a + b)
    return total


def _times(weight: float):
    return lambda x: x * F.lit(weight)


def top_class(probability: Column | str) -> Column:
    """Index of the largest probability (the first on a tie) as a double, as ML predictions are."""
    p = col(probability)
    return (F.array_position(p, F.array_max(p)) - 1).cast("double")
