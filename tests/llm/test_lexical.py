"""Lexical search against the score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.llm import lexical
from tests.llm import fixtures as fx


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fx.lower_ascii(text))


def plain(docs, items, k=10):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item_id, text in items:
        scores = []
        for i, b, n in bags:
            m = 25 + (75 * n * n_docs) // length
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t, r in Counter(plain_terms(text)).items() if t in b)
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item_id, rank, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").withColumn("score", F.lit("clash")).withColumn("uid", F.lit("clash"))


def test_equals_every_score(spark):
    texts = fx.odd_texts()
    docs = fx.documents(spark, texts + ["Ünïcödé É 7" * 3, "a " * 400_000, "x" * (lexical.PIECE + 5) + " A b"])
    asked = items(spark, [texts[8], None, "", "...", "a b c a", texts[9] + " " + texts[7], "unknown", "ÉÀ É 7ünïcödé", texts[8], "A"])
    want = plain(rows_of(docs, "doc_id", "text"), rows_of(asked, "item_id", "text"))
    assert sorted(rows_of(lexical.rank(docs, asked), "item_id", "rank", "doc_id", "score"), key=repr) == want


def test_batches_of_queries_and_empty_tables(spark, monkeypatch):
    docs = fx.documents(spark, parts=2)
    asked = items(spark, [t for t in fx.odd_texts(3) if t][10:13])
    monkeypatch.setattr(lexical, "BATCH_ITEMS", 2)  # read by the driver only
    want = plain(rows_of(docs, "doc_id", "text"), rows_of(asked, "item_id", "text"), 3)
    assert sorted(rows_of(lexical.rank(docs, asked, k=3), "item_id", "rank", "doc_id", "score"), key=repr) == want
    assert lexical.rank(docs, spark.createDataFrame([], "item_id string, text string")).count() == 0
    assert lexical.rank(fx.empty(spark), asked).count() == 0


def shards(bags, together, weights, size):
    signs = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (len(together), lexical.SKETCH))
    names = [c.split()[0] for c in lexical.INDEX.split(", ")]
    for a in range(0, len(bags), size):
        some = bags[a: a + size]
        at = np.cumsum([0] + [len(b) for b in some])
        row = lexical.shard_row(np.arange(a, a + len(some)), at, np.array([t for b in some for t in b]), np.array([w for b in some for w in b.values()]), weights, together, signs)
        yield lexical.Shard(dict(zip(names, row)), together)


@pytest.mark.parametrize("block,topics", [(4, 6), (16, 1), (32, 12)])
def test_blocks_are_skipped_and_nothing_is_missed(monkeypatch, block, topics):
    monkeypatch.setattr(lexical, "BLOCK", block)
    rng = random.Random(block)
    n_terms = 60
    of = [rng.sample(range(n_terms), 12) for _ in range(topics)]
    bags = []
    for _ in range(700):
        pool = rng.choice(of) + list(range(3))
        bags.append({t: rng.choice([400_000, 555_555, 700_001, 1_000_000]) for t in sorted(set(rng.choices(pool, k=8)))})
    bags += [bags[5]] * 300  # copies: equal scores
    weights = np.array([rng.randint(0, 9000) for _ in range(n_terms)])
    queries = [(q, sorted(set(rng.choices(rng.choice(of), k=5) + [0, 1])), None) for q in range(20)]
    queries = [(q, numbers, [rng.randint(1, 2) for _ in numbers]) for q, numbers, _ in queries]
    together = lexical.Batch({t: t for t in range(n_terms)}, queries).together()
    parts = list(shards(bags, together, weights, 250))
    for _, numbers, repeats in queries:
        worth = np.array(repeats) * weights[numbers]
        every = [(-sum(int(w) * b.get(t, 0) for t, w in zip(numbers, worth)), i) for i, b in enumerate(bags)]
        want = sorted(x for x in every if x[0] < 0)[:10]
        best = []
        for part in parts:
            best = part.search(np.array(numbers), worth, best, 1, 10)
        assert best == want
        least = -want[-1][0]
        assert parts[0].search(np.array(numbers), worth, [], least, 10) == sorted(x for x in every[:250] if x[0] <= -least)[:10]


def test_a_bound_skips_blocks(monkeypatch):
    """Documents of another topic share only a frequent term: their blocks can't reach the best scores, so they aren't scored."""
    monkeypatch.setattr(lexical, "BLOCK", 8)
    bags = [{0: 500_000, 1: 900_000, 2: 900_000} if i % 10 == 0 else {0: 500_000, 3: 900_000} for i in range(200)]
    weights, together = np.array([100, 5000, 5000, 5000]), lexical.Batch({t: t for t in range(4)}, [(0, [0, 1, 2], [1, 1, 1]), (1, [0, 3], [1, 1])]).together()
    (part,) = shards(bags, together, weights, 200)
    starts, ends, summary, _ = part.lists[0]
    assert len(starts) == 2 and {len(set(part.members[a:b] % 10 == 0)) for a, b in zip(starts, ends)} == {1}
    scored = []
    part.dense = Counted(part.dense, scored)
    assert part.search(np.array([0, 1, 2]), weights[[0, 1, 2]], [], 1, 10) == [(-(50_000_000 + 9_000_000_000), i) for i in range(0, 100, 10)]
    assert sum(scored) == 20


class Counted:
    """An array that notes how many rows are read."""

    def __init__(self, array, scored):
        self.array, self.scored = array, scored

    def __getitem__(self, place):
        out = self.array[place]
        self.scored.append(len(out))
        return out
