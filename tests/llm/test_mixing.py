"""Mixing of sources against a plain running sum."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridlens.llm import mixing
from tests.llm import fixtures as fx

WORD = r"[^\x20\x09-\x0D]+"


def plain_targets(sizes, weights, limit, total=None):
    """Sources at their limit leave the sharing one by one."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = sum(sizes.values()) if total is None else total, set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > limit * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(limit * sizes[s])
            left -= limit * sizes[s]
            free.discard(s)
    return target


def plain(rows, weights=(1, 2, 3), limit=3, seed="mix", total=None):
    sized = [(hashlib.md5(":".join([seed, *([] if i is None else [str(i)]), *([] if t is None else [t])]).encode()).hexdigest(), -(1 << 63) if i is None else i, len(re.findall(WORD, t or "")), i, s) for i, t, s in rows]
    sizes = {s: 0 for *_, s in sized}
    for _, _, n, _, s in sized:
        sizes[s] += n
    target, out, used = plain_targets(sizes, weights, limit, total), [], Counter()
    for _, _, n, i, s in sorted(sized, key=lambda x: x[:3]):
        epochs, rest = divmod(math.floor(target[s] + 1e-7), max(sizes[s], 1))
        out.append((i, s, n, sizes[s], epochs * n + max(0, min(n, rest - used[s]))))
        used[s] += n
    return out, target


def check(docs, **settings):
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    want, target = plain(rows, **settings)
    got = mixing.mix(docs, **settings).collect()
    assert Counter((r.doc_id, r.source, r.size, r.source_size, r.taken) for r in got) == Counter(want)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.taken <= settings.get("limit", 3) * r.size
    for s, t in target.items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= 1
    return got


def test_odd_texts(spark):
    docs = fx.documents(spark)
    first = check(docs)
    assert sorted(map(tuple, first), key=repr) == sorted((tuple(r) for r in mixing.mix(docs.repartition(7)).collect()), key=repr)
    assert mixing.mix(fx.empty(spark)).count() == 0 and mixing.texts(fx.empty(spark)).count() == 0
    nothing = fx.documents(spark, [None, "", " \n "])
    assert {(r.size, r.taken, r.target) for r in mixing.mix(nothing).collect()} == {(0, 0, 0.0)}


def test_small_sources_repeat_up_to_the_limit(spark):
    texts = ["w " * n for n in (900, 4, 3, 70, 5, 8, 1, 0, 30)]
    docs = fx.documents(spark, texts).withColumn("source", F.element_at(F.array(*[F.lit(x) for x in ("big", "c", "d")], F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int")))
    check(docs)
    check(docs, weights=(5, 1), limit=7, seed="x", total=400)


@pytest.mark.parametrize("rows", [1, 10])
def test_a_cut_through_copies_and_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows)
    copy = [(7, "the same words in a row", "a")] * 60
    frame = spark.createDataFrame(copy + [(i, "x " * (i % 9), "abc"[i % 3]) for i in range(90)], "doc_id long, text string, source string").repartition(6)
    check(frame, weights=(3, 1, 7))
    only = spark.createDataFrame([*copy, (8, "z " * 5000, "b")], "doc_id long, text string, source string").repartition(6)
    check(only)


def test_texts_hold_what_is_taken(spark):
    docs = fx.documents(spark).withColumn("_id", F.lit("clash"))
    rows = mixing.texts(docs).collect()
    taken = Counter()
    for r in rows:
        n = len(re.findall(WORD, r.row.text))
        assert n > 0 and r.row.fp == "clash" and r.row._id == "clash"
        taken[r.row.source] += n
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.source] += r.taken
    assert taken == want
    whole = {r.text for r in docs.select("text").collect()}
    assert sum(r.row.text not in whole for r in rows) <= docs.select("source").distinct().count()
