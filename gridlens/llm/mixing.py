"""Mixing of sources to target weights, with a budget in words for each source.

Every row has a random key, the MD5 of a seed, its id and its text, so the order of rows is the same in each run and on any cluster. Keys are
ranged by their leading bits inside each source; sizes are summed by range with map-side combining, and prefix sums over the ranges show in which
one the budget of a source ends. Only that range is sorted, to find the row at which the budget is used up. All other rows only compare their
key with the one at the cut, in the scan that returns them: rows are never shuffled, and a source with a third of them is like any other.

A budget above a source's size begins another epoch: all of its rows are taken as often as they fit as a whole, and the cut is made in the rest.
The row at the cut is taken in part, by its first words, so a source's words are its budget exactly (the target, rounded down to whole words).

Targets share the words of all sources by weight. No target is above ``limit`` times the source's size; what is left over is shared again by weight until none is
above. That level is the greatest of (what is left) / (weights that are left) over the sources in order of size by weight, so no rounds are needed.

Null texts and texts without words have size 0 and are taken 0 times; a null source is a source of its own, the last one; null ids are rows like others.
Repeated rows are rows of their own, numbered among themselves where the cut goes through them. Sizes are counted over whole texts of any length. An empty table
gives no rows. Columns of other names pass through ``texts``, also those that clash with names used here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import NO_ID, stage
from gridlens.operators import ordered
from gridlens.session import LOOKUP_ROWS, lookup, max_group_rows

#: Rows that a range of keys should hold, on average over all sources.
RANGE_ROWS = 4_096
BLANK = r"\x20\x09-\x0D"


def words(text: Column) -> Column:
    """The number of words in a text; null has none."""
    rest = F.regexp_replace(F.regexp_replace(text, f"^[{BLANK}]++", ""), f"[^{BLANK}]++[{BLANK}]*+", "w")
    return F.coalesce(F.char_length(rest), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    pieces = F.split(text, f"(?<=[^{BLANK}])(?=[{BLANK}])")
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def keyed(seed: str) -> list[Column]:
    """doc_id, source, size, and the place of a row of documents: _key (random), _id (never null), _place (any, tells copies apart)."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    key = F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"), text).cast("binary"))
    columns = {"doc_id": doc_id, "source": F.col("source").cast("string"), "size": words(text), "_key": key, "_id": F.coalesce(doc_id, F.lit(NO_ID))}
    return [c.alias(name) for name, c in (columns | {"_place": F.monotonically_increasing_id()}).items()]


def targets(sources: DataFrame, weights: Sequence[int], limit: int, total: int | None = None) -> DataFrame:
    """Adds target, epochs (whole ones) and rest (words of one more epoch) to a table of source, source_size."""
    split = sources.count() > max_group_rows(sources.sparkSession)
    numbered = ordered.scan(sources, [], [F.col("source").asc_nulls_last()], [ordered.row_number("place")], split)
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = numbered.withColumn("weight", F.get(cycle, ((F.col("place") - 1) % len(weights)).cast("int")))
    sums = weighed.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    if not sums.w:
        return weighed.select("source", "source_size", F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("epochs"), F.lit(0).cast("long").alias("rest"))
    # Sources that reach their limit come first in this order: those before a row are taken at their limit.
    by_ratio = [F.col("source_size").cast("double") / F.col("weight"), F.col("place")]
    full = F.lit(limit) * F.col("source_size")
    running = ordered.scan(weighed, [], by_ratio, [ordered.running("_full", "sum", full), ordered.running("_weight", "sum", "weight")], split)
    left = (F.lit(sums.s if total is None else total) - F.col("_full") + full).cast("double")
    level = running.agg(F.max(left / (F.lit(sums.w) - F.col("_weight") + F.col("weight")))).first()[0]
    target = F.least(full.cast("double"), F.lit(max(level, 0.0)) * F.col("weight"))
    budget, size = F.floor("target").cast("long"), F.col("source_size")
    out = weighed.select("source", "source_size", target.alias("target"))
    return out.select(
        "*", F.when(size > 0, (budget - budget % size) / size).otherwise(0).cast("long").alias("epochs"), F.when(size > 0, budget % size).otherwise(0).cast("long").alias("rest"))


def cuts(rows: DataFrame, budgets: DataFrame, n_rows: int) -> DataFrame:
    """source, and the row at which its last epoch ends: cut_key, cut_id, cut_size, and cut_left (words that its copies may still take)."""
    bits = min(24, max(0, (n_rows // RANGE_ROWS).bit_length()))
    span = F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), 32 - bits)
    spans = rows.groupBy("source", span.alias("_span")).agg(F.sum("size").alias("_in"))
    spans = ordered.scan(spans, ["source"], [F.col("_span")], [ordered.running("_end", "sum", "_in")], 1 << bits > max_group_rows(rows.sparkSession))
    rest = budgets.filter("rest > 0").select(F.col("source").alias("_source"), "rest")
    few = budgets.count() <= LOOKUP_ROWS

    def holding(table: DataFrame, inside: str) -> DataFrame:
        """The rows of a running sum (_end) in which the budget of their source ends."""
        at = table.join(F.broadcast(rest) if few else rest, F.col("source").eqNullSafe(F.col("_source")))
        return at.filter((F.col("_end") - F.col(inside) <= F.col("rest")) & (F.col("rest") < F.col("_end")))

    held = holding(spans, "_in").select(F.col("source").alias("_source"), F.col("_span").alias("_held"), (F.col("_end") - F.col("_in")).alias("_before"))
    inside = rows.withColumn("_span", span).join(lookup(held), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_span") == F.col("_held")))
    groups = inside.groupBy("source", "_before", "_key", "_id", "size").agg((F.count("*") * F.col("size")).alias("_in"))
    groups = ordered.scan(groups, ["source"], [F.col("_key"), F.col("_id"), F.col("size")], [ordered.running("_end", "sum", "_in")])
    at = holding(groups.withColumn("_end", F.col("_end") + F.col("_before")), "_in")
    return at.select(
        F.col("source").alias("_of"), F.col("_key").alias("cut_key"), F.col("_id").alias("cut_id"), F.col("size").alias("cut_size"),
        (F.col("rest") - F.col("_end") + F.col("_in")).alias("cut_left"))


def shares(rows: DataFrame, weights: Sequence[int], limit: int, total: int | None = None) -> DataFrame:
    """Adds source_size, target and taken to staged rows with the columns of ``keyed``."""
    sums = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")), "mix-sources")
    n_rows = sums.agg(F.sum("_n")).first()[0] or 0
    budgets = stage(targets(sums.drop("_n"), weights, limit, total), "mix-targets")
    cut = stage(cuts(rows.select("source", "size", "_key", "_id"), budgets, n_rows), "mix-cuts")
    plan = budgets.join(cut, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of").withColumnRenamed("source", "_of")
    few = budgets.count() <= LOOKUP_ROWS
    joined = rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_of")))
    mine, cut_at = F.struct("_key", "_id", "size"), F.struct("cut_key", "cut_id", "cut_size")
    known = F.col("cut_key").isNotNull()
    more = F.when(known & (mine < cut_at), F.col("size")).otherwise(0)
    split = F.coalesce(known & (mine == cut_at) & (F.col("size") > 0), F.lit(False))
    # The copies at a cut are numbered; where there is a single one, or hardly any, this is a handful of rows.
    tied = ordered.scan(joined.filter(split), ["source"], [F.col("_place")], [ordered.row_number("_copy")])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut_left") - (F.col("_copy") - 1) * F.col("size")))
    columns = [*rows.columns, "source_size", "target"]
    whole = joined.filter(~split).select(*columns, (F.col("epochs") * F.col("size") + more).cast("long").alias("taken"))
    return whole.unionByName(tied.select(*columns, (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), limit: int = 3, total: int | None = None, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words that the mix takes, repeats counted) of each row.

    ``weights`` go to the sources in order of code points, again and again. ``total`` words are shared, those of all rows unless it is given.
    """
    rows = stage(docs.select(*keyed(seed)), "mix-rows")
    return shares(rows, weights, limit, total).select("doc_id", "source", "size", "source_size", "target", "taken")


def texts(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), limit: int = 3, total: int | None = None, seed: str = "mix") -> DataFrame:
    """The mixed rows: all columns of ``docs`` (struct ``row``), and ``epoch``, once per epoch; the row at a cut with its first words only."""
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    taken = shares(stage(docs.select(held, *keyed(seed)), "mix-texts"), weights, limit, total).filter("taken > 0")
    each = taken.select("row", "size", "taken", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)).alias("epoch"))
    here = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    cut = F.when(here < F.col("size"), first_words(F.col("row.text"), here)).otherwise(F.col("row.text"))
    return each.select(F.col("row").withField("text", cut).alias("row"), "epoch")
