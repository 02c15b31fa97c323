"""Benchmark decontamination as a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (the whole item if it is shorter). It occurs in a text if its words stand
there in a row. Windows are sets of placed shingles (three neighbouring words), and a window occurs only if all of them do, so one
necessary shingle, the prefix, is enough to find candidates. All documents are searched for shingles of the benchmark; their counts
order them by rarity, windows with a shingle that no text has are out, and each other window is looked up by its rarest one. What its
place allows by length and position becomes a diagonal (text, item, shift). Only on diagonals the other shingles are compared, and a
window is found where all its shingles stand side by side.

Everything is columns and joins: texts are read once, and what leaves the scan is a row per text and a row per shingle that the benchmark
has too. A passage that a third of all texts share gives rows in proportion to these texts, spread by text.

Null and empty texts or items have no words. Repeated rows give equal rows; repeated item ids count as one item. An empty table of
texts gives no rows; an empty benchmark hits nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.llm.common import row_key, stage

WINDOW, SHINGLE = 13, 3
#: What separates words: control characters, ASCII punctuation, blanks (A-Z are lower-cased before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a benchmark table that may be broadcast; larger ones are joined by a shuffle.
SMALL = 500_000


def lower_ascii(text: Column) -> Column:
    """Only A-Z in lower case; ``lower`` does that for texts without other letters and is much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """A staged table, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= rows else df


def benchmark_shingles(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item (text of the id), ipos, shingle, size (words of the shingle), need (shingles of a window), span (words of a window)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.distinct().withColumn("copy", F.xxhash64("w"))  # an item id with several texts keeps all of them
    n = F.size("w")
    items = items.select("item", "copy", "w", F.least(n, F.lit(SHINGLE)).alias("size"), F.least(n, F.lit(window)).alias("span"))
    places = F.sequence(F.lit(0), F.size("w") - F.col("size"))
    return items.withColumn("ipos", F.explode(places)).select(
        "item", "copy", "ipos", F.concat_ws(" ", F.slice("w", F.col("ipos") + 1, F.col("size"))).alias("shingle"), "size",
        (F.col("span") - F.col("size") + 1).alias("need"), "span",
    )


def hits(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """A row per text (pos -1) and one per shingle of the vocabulary in it: _id, _row, doc_id, n_words, pos, shingle."""
    sizes = [r[0] for r in vocabulary.select("size").distinct().collect()]  # at most 1 to 3
    rows = docs.select(*row_key(docs), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    rows = rows.withColumn("n_words", F.size("w"))
    place = F.explode(F.sequence(F.lit(-1), F.size("w") - 1))  # -1 keeps the text itself
    rows = rows.select("*", place.alias("pos"))

    def shingle(size: int) -> Column:
        parts = [F.get("w", F.col("pos") + k) for k in range(size)]
        return F.when((F.col("pos") >= 0) & (F.col("pos") + size <= F.col("n_words")), F.concat_ws(" ", *parts))

    keep = ["_id", "_row", "doc_id", "n_words", "pos"]
    if len(sizes) == 1:
        rows = rows.select(*keep, shingle(sizes[0]).alias("shingle"))
    elif sizes:
        each = F.array(*[F.struct(F.lit(s).alias("size"), shingle(s).alias("shingle")) for s in sizes])
        rows = rows.select(*keep, F.explode(each).alias("s")).select(*keep, "s.shingle", "s.size")
        rows = rows.filter(f"(pos >= 0 and shingle is not null) or (pos < 0 and size = {sizes[0]})").drop("size")
    else:
        return rows.filter("pos < 0").select(*keep, F.lit(None).cast("string").alias("shingle"))
    known = vocabulary.select(F.col("shingle").alias("known")).distinct()
    known = small(stage(known, "benchmark-shingles"))
    return rows.join(known, rows.shingle == known.known, "left").filter("known is not null or pos < 0").select(*keep, "shingle")


def occurrences(found: DataFrame, grams: DataFrame) -> DataFrame:
    """Occurring windows: _id, _row, item, begin (word) and span, without repetitions."""
    place = ["item", "copy", "ipos"]
    counts = found.filter("pos >= 0").groupBy("shingle").agg(F.count("*").alias("freq"))
    ahead = Window.partitionBy("item", "copy").orderBy("ipos").rangeBetween(0, WINDOW - 1)
    ranked = grams.join(F.broadcast(counts) if grams.count() <= SMALL else counts, "shingle", "left")  # as many as the benchmark has
    inside = F.sort_array(F.slice(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "shingle", "ipos")).over(ahead), 1, F.col("need")))
    windows = ranked.withColumn("inside", inside).filter(F.size("inside") == F.col("need"))
    windows = windows.select("item", "copy", "ipos", "span", F.col("inside")[0].alias("rare")).filter("rare.freq > 0")
    prefixes = stage(windows.select("item", "copy", "span", F.col("ipos").alias("first"), F.col("rare.shingle").alias("shingle"), F.col("rare.ipos").alias("at")), "prefixes")
    marks = found.filter("pos >= 0").select("_id", "_row", "n_words", "pos", "shingle")
    begin = F.col("pos") - F.col("at") + F.col("first")
    diagonals = marks.join(small(prefixes), "shingle").filter((begin >= 0) & (begin + F.col("span") <= F.col("n_words")))
    diagonals = diagonals.select("_id", "_row", "item", "copy", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    expected = diagonals.join(small(grams.select(*place, "shingle", "need", "span")), ["item", "copy"])
    expected = expected.withColumn("pos", F.col("shift") + F.col("ipos")).filter("pos >= 0")
    matched = expected.join(marks.select("_id", "_row", "pos", "shingle").distinct(), ["_id", "_row", "pos", "shingle"])
    run = Window.partitionBy("_id", "_row", "item", "copy", "shift").orderBy("ipos").rangeBetween(0, WINDOW - SHINGLE)
    whole = matched.withColumn("n", F.count("*").over(run)).filter("n = need")
    return whole.select("_id", "_row", "item", F.col("pos").alias("begin"), "span").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items (sorted ids), items_sha256, contaminated (1 / share of the words or more is hit)."""
    grams = stage(benchmark_shingles(benchmark), "benchmark-windows")
    found = stage(hits(docs, grams), "benchmark-hits")
    each = occurrences(found, grams)
    covered = F.aggregate(
        F.sort_array(F.collect_set(F.struct("begin", (F.col("begin") + F.col("span")).alias("end")))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["begin"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")),
    )["n"]
    per_text = each.groupBy("_id", "_row").agg(covered.alias("hit"), F.sort_array(F.collect_set("item")).alias("items"))
    texts = found.filter("pos < 0").select("_id", "_row", "doc_id", "n_words")
    out = texts.join(per_text, ["_id", "_row"], "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), "_id", "_row",
    )


def clean(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated."""
    bad = contamination(docs, benchmark, share).filter("contaminated").select(F.col("_id").alias("_bad_id"), F.col("_row").alias("_bad_row")).distinct()
    key = row_key(docs)
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], key[0].alias("_k_id"), key[1].alias("_k_row"))
    kept = keyed.join(bad, (F.col("_k_id") == F.col("_bad_id")) & (F.col("_k_row") == F.col("_bad_row")), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS span, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
spans AS (SELECT DISTINCT span FROM win),
places AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
occ AS (SELECT p.rid, p.i, win.span, win.item FROM places p CROSS JOIN spans s
        JOIN win ON win.span = s.span AND p.i + s.span - 1 <= len(p.w) AND win.s = array_to_string(list_slice(p.w, p.i, p.i + s.span - 1), ' ')),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + span)) AS k FROM (SELECT DISTINCT rid, i, span FROM occ)) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""
