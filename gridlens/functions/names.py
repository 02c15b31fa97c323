"""Column-name rules: clean names, find targets, align to a saved feature list."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sanitise(names: list[str]) -> list[str]:
    """Lower-case names with ``_`` for other characters; names that then collide get ``_2``, ``_3`` …"""
    seen: set[str] = set()
    out = []
    for name in names:
        base = re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_") or "column"
        candidate, n = base, 1
        while candidate in seen:
            n += 1
            candidate = f"{base}_{n}"
        seen.add(candidate)
        out.append(candidate)
    return out


def sanitise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*sanitise(df.columns))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def find_target(columns: list[str], exact: tuple[str, ...] = ("label", "attack_type", "class", "target")) -> str | None:
    """The target column: an exact name first, else the first one that contains attack, label or class."""
    lowered = {c.strip().lower(): c for c in reversed(columns)}
    for name in exact:
        if name in lowered:
            return lowered[name]
    for c in columns:
        if any(word in c.lower() for word in ("attack", "label", "class")):
            return c
    return None


def similarity(a: str, b: str) -> float:
    """Edit similarity of two names in percent, case-blind."""
    a, b = a.strip().lower(), b.strip().lower()
    if not a and not b:
        return 100.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return 100.0 * (1 - row[-1] / max(len(a), len(b)))


def fuzzy_column(columns: list[str], wanted: str, score: float = 80.0) -> str | None:
    """The column whose name is most like ``wanted`` (at least ``score`` percent)."""
    ranked = sorted(columns, key=lambda c: (-similarity(c, wanted), c))
    return ranked[0] if ranked and similarity(ranked[0], wanted) >= score else None


def unique_columns(df: DataFrame) -> DataFrame:
    """Keep the first of several columns that share a name."""
    keep, seen = [], set()
    for i, name in enumerate(df.columns):
        if name.lower() not in seen:
            seen.add(name.lower())
            keep.append((i, name))
    positional = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return positional.select(*[F.col(f"__c{i}").alias(name) for i, name in keep])


def align(df: DataFrame, features: list[str], keep: tuple[str, ...] = (), fill: float = 0.0) -> DataFrame:
    """Exactly the saved features, in their order: missing ones are the fill value, others are dropped."""
    have = set(df.columns)
    filled = [
        (F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fill)) if c in have else F.lit(fill)).alias(c)
        for c in features
    ]
    return df.select(*keep, *filled)


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    other = set(b.columns)
    return [c for c in a.columns if c in other]
