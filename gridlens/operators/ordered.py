"""Running values over ordered rows, safe for groups of any size.

A plain window sends each ``partitionBy`` group to one task. That is the best plan
while groups are moderate, so it is used whenever the largest group is at most
``spark.gridlens.maxGroupRows``. Past that (one source with a third of all packets,
or no partition key at all) the rows are range-partitioned on (group, order), which
splits a hot group over many tasks, windows run inside each block, and a small table
with at most two rows per block carries values across block borders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.scalar import col
from gridlens.session import cut_lineage, max_group_rows

_FIRST, _NOW = Window.unboundedPreceding, Window.currentRow


@dataclass(frozen=True)
class Step:
    """One output: ``kind`` is lag, sum, count, max, min or last (last non-null)."""

    name: str
    kind: str
    value: Column


def lag(name: str, value: Column | str) -> Step:
    return Step(name, "lag", col(value))


def running(name: str, kind: str, value: Column | str) -> Step:
    return Step(name, kind, col(value))


def row_number(name: str) -> Step:
    return Step(name, "count", F.lit(1))


def group_sizes(df: DataFrame, by: list[str]) -> tuple[int, int]:
    """(rows of the biggest group, all rows); one narrow scan with map-side counts."""
    if not by:
        rows = df.count()
        return rows, rows
    row = df.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    return row[0] or 0, row[1] or 0


def largest_group(df: DataFrame, by: list[str]) -> int:
    return group_sizes(df, by)[0]


def scan(df: DataFrame, by: list[str], order: list, steps: list[Step], split: bool | None = None) -> DataFrame:
    """Add each step's running value to every row, in ``order`` within ``by``.

    ``order`` must decide the place of each row (end it with a unique id). For values
    of the following row, reverse the order. ``split`` forces one of the two plans.
    """
    order = [col(o) for o in order]
    spark = df.sparkSession
    blocks, limit = int(spark.conf.get("spark.sql.shuffle.partitions")), max_group_rows(spark)
    if split is None:
        largest, total = group_sizes(df, by)
        split = largest > limit
        blocks = max(blocks, -(-total // limit))  # a block is no wider than a group may be
    return _split_scan(df, by, order, steps, blocks) if split else _plain_scan(df, by, order, steps)


def _over(step: Step, value: Column, window) -> Column:
    run = window.rowsBetween(_FIRST, _NOW)
    return {
        "lag": lambda: F.lag(value).over(window),
        "sum": lambda: F.sum(value).over(run),
        "count": lambda: F.count(value).over(run),
        "max": lambda: F.max(value).over(run),
        "min": lambda: F.min(value).over(run),
        "last": lambda: F.last(value, ignorenulls=True).over(run),
    }[step.kind]()


def _plain_scan(df, by, order, steps):
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return df.select("*", *[_over(s, s.value, window).alias(s.name) for s in steps])


def _split_scan(df, by, order, steps, blocks):
    inputs = {s.name: f"__in{i}" for i, s in enumerate(steps)}
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    prepared = df.select("*", key.alias("__key"), *[s.value.alias(inputs[s.name]) for s in steps])
    sort_keys = [F.col(b) for b in by] + order
    placed = cut_lineage(
        prepared.repartitionByRange(blocks, *sort_keys)
        .sortWithinPartitions(*sort_keys)
        .withColumn("__seq", F.monotonically_increasing_id())
    ).withColumn("__blk", F.shiftright("__seq", 33))

    # One row per block: the groups at its two ends. Only they can cross a border.
    ends = placed.groupBy("__blk").agg(
        F.min_by("__key", "__seq").alias("__head"), F.max_by("__key", "__seq").alias("__tail")
    )
    at_edge = placed.join(F.broadcast(ends), "__blk").filter(
        F.col("__key").eqNullSafe(F.col("__head")) | F.col("__key").eqNullSafe(F.col("__tail"))
    )
    partial = {
        "lag": lambda c: F.max_by(F.struct(F.col(c).alias("v")), "__seq"),
        "sum": lambda c: F.sum(c),
        "count": lambda c: F.count(c),
        "max": lambda c: F.max(c),
        "min": lambda c: F.min(c),
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__seq"))),
    }
    edges = at_edge.groupBy("__blk", "__key").agg(
        *[partial[s.kind](inputs[s.name]).alias(f"__e{i}") for i, s in enumerate(steps)]
    )
    before = Window.partitionBy("__key").orderBy("__blk").rowsBetween(_FIRST, -1)
    merge = {
        "lag": lambda c: F.last(c).over(before),
        "sum": lambda c: F.sum(c).over(before),
        "count": lambda c: F.sum(c).over(before),
        "max": lambda c: F.max(c).over(before),
        "min": lambda c: F.min(c).over(before),
        "last": lambda c: F.last(c, ignorenulls=True).over(before),
    }
    carried = edges.select(
        F.col("__blk").alias("__cblk"),
        F.col("__key").alias("__ckey"),
        *[merge[s.kind](f"__e{i}").alias(f"__c{i}") for i, s in enumerate(steps)],
    )
    joined = placed.join(
        F.broadcast(carried),  # at most two rows per block
        (F.col("__blk") == F.col("__cblk")) & F.col("__key").eqNullSafe(F.col("__ckey")),
        "left",
    )
    window = Window.partitionBy("__blk", "__key").orderBy("__seq")

    def combined(i: int, s: Step) -> Column:
        value, carry = F.col(inputs[s.name]), F.col(f"__c{i}")
        if s.kind == "lag":
            return F.coalesce(F.lag(F.struct(value.alias("v"))).over(window), carry)["v"]
        here = _over(s, value, window)
        if s.kind == "sum":
            return F.coalesce(here + carry, here, carry)
        if s.kind == "count":
            return here + F.coalesce(carry, F.lit(0))
        if s.kind == "max":
            return F.greatest(here, carry)
        if s.kind == "min":
            return F.least(here, carry)
        return F.coalesce(here, carry)

    results = joined.select("*", *[combined(i, s).alias(f"__r{i}") for i, s in enumerate(steps)])
    return results.select(*df.columns, *[F.col(f"__r{i}").alias(s.name) for i, s in enumerate(steps)])
