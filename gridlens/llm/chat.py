"""Preference formatting of conversations.

A pair is a chosen and a rejected conversation. The turns that both begin with, by role and text, are the prompt and are rendered once; the
turns after them are rendered as two completions. Only what an assistant says in a completion, and the end mark behind it, is to be learnt:
the spans hold where that is, counted in characters of prompt + completion. All else is masked.

Turns are put in order by number, then role and text; null roles and texts are empty, null numbers come first, and a null key is one
conversation. Repeated turns stay. A pair with one side only has an empty other side; equal conversations are all prompt and have two empty
completions. An empty table gives no rows; other columns are ignored. A conversation is one row of the result, so its turns meet in
one task; nothing else is gathered. Texts of any length are rendered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of the rendered text: around the role, and after the text.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LEARNT = len("<|end|>")


def turns_of(conversations: DataFrame, key: str, name: str) -> DataFrame:
    """One row per conversation: its turns in order, as an array of (role, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = conversations.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(turn)).alias(name))
    return rows.select("_key", F.transform(name, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias(name))


def shared(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_min(F.filter(places, lambda i: F.get(a, i) != F.get(b, i))), n)


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(CLOSE), x["text"], F.lit(END))), "")


def spans(turns: Column, start: Column) -> Column:
    """(start, end) of what is learnt in turns whose rendering begins at ``start``."""
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    empty = F.struct(start.cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(kind)

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.char_length(turn["role"]) + len(OPEN + CLOSE)
        end = begin + F.char_length(turn["text"])
        one = F.array(F.struct(begin.alias("start"), (end + LEARNT).alias("end")))
        found = F.when(turn["role"] == "assistant", F.concat(state["spans"], one)).otherwise(state["spans"])
        return F.struct((end + len(END)).alias("at"), found.alias("spans")).cast(kind)

    return F.aggregate(turns, empty, step)["spans"]


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, n_shared, prompt, chosen, rejected (completions), chosen_spans, rejected_spans of pairs given as tables of key, turn, role, text."""
    a, b = turns_of(chosen, key, "_a"), turns_of(rejected, key, "_b")
    both = a.join(b.withColumnRenamed("_key", "_other"), F.col("_key").eqNullSafe(F.col("_other")), "full")
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = both.select(F.coalesce("_key", "_other").alias("_key"), F.coalesce("_a", none).alias("_a"), F.coalesce("_b", none).alias("_b"))
    both = both.withColumn("_n", shared(F.col("_a"), F.col("_b")))
    rest = [F.slice(c, F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0))) for c in ("_a", "_b")]
    both = both.select("_key", "_n", rendered(F.slice("_a", 1, F.col("_n"))).alias("prompt"), rest[0].alias("_a"), rest[1].alias("_b"))
    size = F.char_length("prompt")
    return both.select(
        F.col("_key").alias(key), F.col("_n").alias("n_shared"), "prompt", rendered(F.col("_a")).alias("chosen"), rendered(F.col("_b")).alias("rejected"),
        spans(F.col("_a"), size).alias("chosen_spans"), spans(F.col("_b"), size).alias("rejected_spans"),
    )


def mismatched(conversations: DataFrame) -> DataFrame:
    """Rejected conversations: the last answer of each is exchanged for the last answer of the one beside it (ids 2k and 2k + 1).

    A conversation without an answer, or whose neighbour has none, stays as it is.
    """
    place = F.struct(F.col("turn").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    answers = conversations.filter("role = 'assistant' and conv_id is not null").groupBy("conv_id").agg(F.max(place).alias("last"))
    answers = answers.select("conv_id", F.col("last.col1").alias("last_turn"), F.col("last.col2").alias("last_text"))
    beside = answers.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last_text").alias("other_text"))
    swap = answers.join(beside, "conv_id").select(F.col("conv_id").alias("_of"), "last_turn", "last_text", "other_text")
    rows = conversations.join(swap, F.col("conv_id") == F.col("_of"), "left")
    is_last = (F.col("role") == "assistant") & F.col("turn").cast("long").eqNullSafe(F.col("last_turn")) & (F.coalesce("text", F.lit("")) == F.col("last_text"))
    return rows.select("conv_id", "turn", "role", F.when(is_last & F.col("other_text").isNotNull(), F.col("other_text")).otherwise(F.col("text")).alias("text"))


def listed(spans_column: str) -> Column:
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")


ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations),
last AS (SELECT conv_id, max(struct_pack(a := turn, b := text)) AS m FROM t WHERE role = 'assistant' GROUP BY conv_id),
turns AS (SELECT t.conv_id, row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn, t.role, t.text) AS k, t.role, t.text,
            CASE WHEN t.role = 'assistant' AND t.turn = o.m.a AND t.text = o.m.b AND p.m IS NOT NULL THEN p.m.b ELSE t.text END AS other
          FROM t LEFT JOIN last o ON o.conv_id = t.conv_id LEFT JOIN last p ON p.conv_id = xor(t.conv_id, 1)),
n AS (SELECT conv_id, coalesce(min(k) FILTER (WHERE text <> other) - 1, count(*)) AS n FROM turns GROUP BY conv_id),
r AS (SELECT conv_id, k, n, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS a,
        '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) AS b FROM turns JOIN n USING (conv_id)),
e AS (SELECT *, sum(length(a)) OVER (PARTITION BY conv_id ORDER BY k) AS ea, sum(length(b)) OVER (PARTITION BY conv_id ORDER BY k) AS eb FROM r)
SELECT conv_id, CAST(any_value(n) AS INTEGER) AS n_shared,
  coalesce(string_agg(a, '' ORDER BY k) FILTER (WHERE k <= n), '') AS prompt,
  coalesce(string_agg(a, '' ORDER BY k) FILTER (WHERE k > n), '') AS chosen, coalesce(string_agg(b, '' ORDER BY k) FILTER (WHERE k > n), '') AS rejected,
  coalesce(string_agg((ea - length(a) + 14) || '-' || (ea - 1), ',' ORDER BY k) FILTER (WHERE k > n AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((eb - length(b) + 14) || '-' || (eb - 1), ',' ORDER BY k) FILTER (WHERE k > n AND role = 'assistant'), '') AS rejected_spans
FROM e GROUP BY conv_id
"""
