"""Repeatable sampling, splitting and balancing by hash order of a unique row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.hashing import hash31, unit
from gridlens.functions.scalar import col
from gridlens.operators import ordered
from gridlens.operators.quantiles import BRACKET, order_statistics


def group_counts(df: DataFrame, label: str, limit: int = 10_000) -> dict:
    """Rows per class; more than ``limit`` classes are refused, for each becomes an expression of the plan."""
    found = df.groupBy(label).agg(F.count(F.lit(1))).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{label} has more than {limit} values: it is no class")
    return {r[0]: r[1] for r in found}


def smallest_by_hash(df: DataFrame, row_id: str, seed: int, wanted: dict, label: str | None = None,
                     counts: dict | None = None) -> Column:
    """Predicate that is true for exactly ``wanted[class]`` rows of each class, the smallest by (hash, id).

    The cut-off hash of each class is an exact order statistic found by scans, so rows are
    filtered where they lie: nothing is sorted or shuffled, however large a class is.
    """
    counts = counts or (group_counts(df, label) if label else {None: df.count()})
    h = hash31(row_id, seed)
    part = [c for c in wanted if 0 < wanted[c] < counts.get(c, 0)]
    member = {c: (F.lit(True) if label is None else F.col(label).eqNullSafe(F.lit(c))) for c in wanted}
    names = {c: f"g{i}" for i, c in enumerate(part)}
    predicate = F.lit(False)
    for c in wanted:
        if wanted[c] >= counts.get(c, 0):
            predicate = predicate | member[c]
    if not part:
        return predicate
    hashed = df.select(F.col(row_id).alias("id"), *([] if label is None else [label]), h.cast("double").alias("h"))
    hashes = hashed.select("id", *[F.when(member[c], F.col("h")).alias(names[c]) for c in part])
    cuts = order_statistics(
        hashes, {names[c]: counts[c] for c in part}, [(names[c], wanted[c] - 1) for c in part], BRACKET
    )
    cut = {c: int(cuts[(names[c], wanted[c] - 1)]) for c in part}
    # Rows that share the cut-off hash are few: ids are unique and the hash has 2^31 values.
    found = hashes.agg(*[e for c in part for e in (
        F.count(F.when(F.col(names[c]) < cut[c], 1)), F.collect_list(F.when(F.col(names[c]) == cut[c], F.col("id"))))]).first()
    for i, c in enumerate(part):
        ties = sorted(found[2 * i + 1])[:wanted[c] - found[2 * i]]
        predicate = predicate | (member[c] & ((h < cut[c]) | ((h == cut[c]) & F.col(row_id).isin(ties))))
    return predicate


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all if there are fewer)."""
    return df.where(smallest_by_hash(df, row_id, seed, {None: n}))


def sample_fraction(df: DataFrame, row_id: str, fraction: float, seed: int = 42) -> DataFrame:
    """About the stated fraction; a pure filter."""
    return df.where(unit(row_id, seed) < fraction)


def split(df: DataFrame, row_id: str, test: float = 0.2, label: str | None = None, seed: int = 42,
          name: str = "is_test") -> DataFrame:
    """Mark ``floor(test x n)`` rows as the test part, per class if a label is given."""
    counts = group_counts(df, label) if label else {None: df.count()}
    wanted = {c: int(n * test + 1e-9) for c, n in counts.items()}
    return df.withColumn(name, smallest_by_hash(df, row_id, seed, wanted, label, counts))


def undersample(df: DataFrame, row_id: str, label: str, factor: int = 3, seed: int = 42) -> DataFrame:
    """Keep at most ``factor`` times the smallest class's rows of each class."""
    counts = group_counts(df, label)
    keep = factor * min(counts.values())
    return df.where(smallest_by_hash(df, row_id, seed, {c: min(n, keep) for c, n in counts.items()}, label, counts))


def class_weights(df: DataFrame, label: str) -> dict:
    """Balanced weights n / (k x n_class)."""
    counts = group_counts(df, label)
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def with_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Attach balanced class weights as a literal lookup: one entry per class, no join."""
    weights = class_weights(df, label)
    lookup = F.create_map(*[F.lit(x) for c, w in weights.items() if c is not None for x in (c, float(w))])
    return df.withColumn(name, lookup[F.col(label)])


def with_fold(df: DataFrame, row_id: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold number 0 to k-1 from the id's hash."""
    return df.withColumn(name, F.pmod(hash31(row_id, seed), F.lit(k)).cast("int"))


def systematic(df: DataFrame, order: list, step: int) -> DataFrame:
    """Every ``step``-th row in order, from the first."""
    placed = ordered.scan(df, [], order, [ordered.row_number("__rn")])
    return placed.where((F.col("__rn") - 1) % step == 0).drop("__rn")


def donors(df: DataFrame, row_id: str, value: Column | str, seed: int, name: str) -> DataFrame:
    """(id, name): each row gets the value of the row before it in hash order, the first that of the last.

    This is a random cyclic permutation of the column.
    """
    pairs = df.select(row_id, hash31(row_id, seed).alias("__h"), F.struct(col(value).alias("v")).alias("__s"))
    last = pairs.agg(F.max_by("__s", F.struct("__h", row_id)).alias("s")).first()["s"]
    if last is None:
        return df.select(row_id, col(value).alias(name))
    moved = ordered.scan(pairs, [], ["__h", row_id], [ordered.lag("__d", "__s")])
    kind = pairs.schema["__s"].dataType["v"].dataType
    wrap = F.struct(F.lit(last["v"]).cast(kind).alias("v"))
    return moved.select(row_id, F.coalesce(F.col("__d"), wrap)["v"].alias(name))
