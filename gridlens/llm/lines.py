"""Line dedup by a log-template tree.

A line is a run of tokens, and a token with a digit is a variable field (``<*>``) from the start. The tree has a fixed depth: its first
level is the number of tokens, the next ones are the leading tokens, and lines that are equal so far are parsed together in one leaf. Lines that recur
as they are need no more. For the other ones of a leaf, the texts of each token at each place are counted, and a line keeps its ``constant`` share of tokens that
most texts have at their place (ties: the earlier place); the rest are variable fields. What comes out is the line's template. A token counts if it stands in
``min_documents`` texts at least, and a line without enough such tokens is only its own template, so prose that begins alike is no family. All lines of a family have the
same frequent tokens, so several families in a leaf come to templates of their own, whatever their values. Lines of recurring
templates are dropped from all documents, long and short ones.

A template recurs if it stands in ``min_documents`` different documents. Equal texts are one document. So are, for each template, all near copies that have it: a
text isn't boilerplate because it was copied whole. A text is a near copy if its different lines and those of them that it has in common with other texts have a similarity of ``similar`` or more
(common / (2 x all - common), the Jaccard similarity to a text of the same length). How often a document, or a group of copies, has the line doesn't matter.

Everything is columns, in a fixed number of passes: texts are parsed once into a table of hashes, lines are counted with map-side combining, and only leaves that can
hold a template are looked at token by token. A line that a third of all documents share is as many small rows, spread by their documents.

Null texts stay null; empty texts and lines stay as they are. Repeated rows are one document. A text whose lines are all dropped
becomes empty and keeps its row. Texts and lines of any length are parsed whole; in scripts without blanks, a line of one token is split by characters. An empty table
gives no rows. Columns beside doc_id, text and n_chars pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import row_key, stage

DEPTH, MIN_DOCUMENTS, CONSTANT, SIMILAR = 3, 5, 0.6, 0.8
#: Numbers that may be broadcast.
SMALL = 500_000
#: Letters of scripts without blanks between words: a line of one token with such letters is split by characters.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
#: A place of a template whose value varies.
FIELD = "<*>"


def masked(text: Column) -> Column:
    """A text whose lines have single blanks between tokens and none at their ends, and tokens with a digit, beside other ones, as variable fields.

    Most texts are so already, which is cheaper to see than to do.
    """
    odd = text.rlike(r"[0-9\t\r]")
    uneven = text.contains("  ") | text.contains(" \n") | text.contains("\n ") | text.startswith(" ") | text.endswith(" ")
    plain = F.when(odd | uneven, F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+", " "), " ?\n ?", "\n"))).otherwise(text)
    numbers = F.regexp_replace(plain, r"(?<= )[^ \n0-9]*+[0-9][^ \n]*+|(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+(?= )", FIELD)
    return F.when(odd, numbers).otherwise(plain)


def alone(line: Column) -> Column:
    """A masked line; if it is a single token with more than digits, its runs of digits are variable fields of one character, ``0``."""
    digits = ~F.contains(line, F.lit(" ")) & line.rlike("[0-9]") & line.rlike("[^0-9]")
    return F.when(digits, F.regexp_replace(line, "[0-9]+", "0")).otherwise(line)


def parts(line: Column) -> Column:
    """The tokens of a masked line: its words, or the characters of a single token of a script without blanks, fields as ``<*>``."""
    characters = F.transform(F.split(line, ""), lambda x: F.when(x == "0", FIELD).otherwise(x))
    return F.when(by_characters(line), characters).otherwise(F.split(line, " "))


def by_characters(line: Column) -> Column:
    return ~F.contains(line, F.lit(" ")) & line.rlike(UNSPACED)


def lines(docs: DataFrame) -> DataFrame:
    """A row per line with text: _id, _row, same (the hash of its text), at (its number), line (masked) and whole (its hash)."""
    text = F.col("text").cast("string")
    rows = docs.select(*row_key(docs), F.xxhash64(text).alias("same"), F.posexplode(F.split(masked(text), "\n")).alias("at", "line"))
    return rows.filter("line <> ''").withColumn("line", alone(F.col("line"))).withColumn("whole", F.xxhash64("line"))


def in_tree(rows: DataFrame, depth: int) -> DataFrame:
    """Adds leaf (the place in the tree, as a hash)."""
    line = F.col("line")
    n = F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    words = F.concat_ws(" ", n, F.substring_index("line", " ", depth))
    return rows.withColumn("leaf", F.xxhash64(F.when(by_characters(line), F.concat_ws("", F.char_length(line), F.lit("/"), F.substring(line, 1, depth))).otherwise(words)))


def placed(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The lines of all texts in the tree, written as numbers: texts are parsed once."""
    rows = in_tree(lines(docs), depth)
    return stage(rows.select("_id", "_row", "at", "same", "leaf", "whole"), "lines")


def line_texts(docs: DataFrame, every: DataFrame, wanted: DataFrame) -> DataFrame:
    """(whole, line) of some kinds of lines, each read from one text that has it."""
    few = wanted.count() <= SMALL
    place = every.join(F.broadcast(wanted) if few else wanted, "whole", "left_semi").groupBy("whole").agg(F.min(F.struct("_id", "_row", "at")).alias("p"))
    place = stage(place.groupBy("p._id", "p._row").agg(F.collect_list(F.struct("whole", "p.at")).alias("of")), "line-places")
    texts = docs.select(*row_key(docs), F.col("text").cast("string").alias("text")).join(F.broadcast(place) if few else place, ["_id", "_row"])
    texts = texts.select(F.split(masked(F.col("text")), "\n").alias("all"), F.explode("of").alias("o"))
    return texts.groupBy("o.whole").agg(F.min(alone(F.get("all", F.col("o.at")))).alias("line"))


def small(df: DataFrame) -> DataFrame:
    """A staged table of a few numbers a row, broadcast only if it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def families(docs: DataFrame, every: DataFrame, counted: DataFrame, kinds: DataFrame, min_documents: int, constant: float) -> DataFrame:
    """(whole, template) of the lines that don't recur as they are, but may do so with variable fields."""
    rest = kinds.filter(F.col("n") < min_documents)
    several = F.count("*").alias("kinds"), F.sum("n").alias("n")  # n: a leaf has as many texts at most
    leaves = stage(rest.groupBy("leaf").agg(*several).filter((F.col("kinds") > 1) & (F.col("n") >= min_documents)).select("leaf"), "line-leaves")
    rest = stage(rest.join(small(leaves), "leaf").select("leaf", "whole"), "varied-lines")
    texts = line_texts(docs, every, rest.select("whole"))
    spelled = stage(rest.join(texts, "whole").select("leaf", "whole", parts(F.col("line")).alias("t")), "varied-texts")
    tokens = spelled.select("leaf", "whole", F.size("t").alias("size"), F.posexplode("t").alias("place", "token")).filter(F.col("token") != FIELD)
    of = counted.join(small(rest), ["leaf", "whole"])
    cells = of.join(tokens, ["leaf", "whole"]).groupBy("leaf", "place", "token").agg(F.count_distinct("same").alias("texts"))
    cells = stage(cells.filter(F.col("texts") >= min_documents), "line-cells")
    enough = F.greatest(F.lit(2), F.ceil(F.lit(constant) * F.col("size"))).cast("int")
    kept = tokens.join(small(cells), ["leaf", "place", "token"]).groupBy("leaf", "whole", "size").agg(F.collect_list(F.struct((-F.col("texts")).alias("often"), "place", "token")).alias("kept"))
    kept = kept.filter(F.size("kept") >= enough)
    most = F.slice(F.sort_array("kept"), 1, enough)
    fixed = F.sort_array(F.transform(most, lambda x: F.struct(x["place"].alias("place"), x["token"].alias("token"))))
    return kept.select("whole", F.xxhash64("leaf", fixed).alias("template"))


def templates(docs: DataFrame, every: DataFrame, min_documents: int = MIN_DOCUMENTS, constant: float = CONSTANT, similar: float = SIMILAR) -> DataFrame:
    """``whole`` of the masked lines whose template recurs."""
    counted = stage(every.select("leaf", "whole", "same").distinct(), "line-counts")
    kinds = stage(counted.groupBy("leaf", "whole").agg(F.count("*").alias("n")), "line-kinds")
    equal = kinds.filter(F.col("n") >= min_documents).select("whole", F.col("whole").alias("template"))
    # What stands in several texts, copies or not: its texts are counted anew below.
    found = stage(equal.unionByName(families(docs, every, counted, kinds, min_documents, constant)), "line-templates")
    held = counted.join(small(found), "whole").select("template", "whole", "same")
    texts = stage(held, "templates-of-texts")
    often = texts.select("template", "same").distinct().groupBy("template").count().filter(F.col("count") >= min_documents).select("template")
    texts = stage(texts.join(small(stage(often, "frequent-templates")), "template"), "texts-of-templates")
    common = texts.groupBy("same").agg(F.count("*").alias("common"))
    of = counted.groupBy("same").agg(F.count("*").alias("lines")).join(common, "same")
    own = stage(of.select("same", (F.col("common") < F.lit(similar) * (2 * F.col("lines") - F.col("common"))).alias("own")), "line-documents")
    votes = texts.select("template", "same").distinct().join(own, "same").groupBy("template").agg(F.count_if("own").alias("own"), F.max((~F.col("own")).cast("int")).alias("copies"))
    recurs = stage(votes.filter(F.col("own") + F.col("copies") >= min_documents).select("template"), "recurring-templates")
    return found.join(small(recurs), "template", "left_semi").select("whole").distinct()


def dropped(docs: DataFrame, depth: int = DEPTH, **settings) -> DataFrame:
    """The rows of ``docs`` (struct ``_held``) with the number of lines, of dropped ones, and the text that is left (struct ``_lines``)."""
    every = placed(docs, depth)
    found = stage(templates(docs, every, **settings), "recurring-lines")
    found = F.broadcast(found) if found.count() <= SMALL else found
    out = every.join(found, "whole", "left_semi").groupBy("_id", "_row").agg(F.collect_set("at").alias("_out"))
    key = row_key(docs)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_held"), key[0].alias("_id"), key[1].alias("_row"))
    every = F.split(F.col("_held.text").cast("string"), "\n")
    left = F.concat_ws("\n", F.filter(every, lambda x, i: ~F.array_contains("_out", i)))
    text = F.when(F.col("_out").isNull(), F.col("_held.text").cast("string")).otherwise(left)
    count = F.coalesce(F.size(every), F.lit(0)), F.coalesce(F.size("_out"), F.lit(0))
    return held.join(out, ["_id", "_row"], "left").select(
        "_held", F.struct(F.greatest(count[0], F.lit(0)).alias("n"), F.greatest(count[1], F.lit(0)).alias("out"), text.alias("text")).alias("_lines"))


def clean(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, with recurring lines taken out of the text; n_chars, if there, is counted anew."""
    rows = dropped(docs, **settings)
    columns = []
    for c in docs.columns:
        value = F.col(f"_held.`{c}`")
        if c == "text":
            value = F.col("_lines.text")
        elif c == "n_chars":
            value = F.when(F.col("_lines.out") > 0, F.char_length("_lines.text")).otherwise(value).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return rows.select(*columns)
