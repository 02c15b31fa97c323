"""Token files, packing, sharding and the encoder."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridlens.llm import packing, sharding, tokenfile
from gridlens.llm.tokens import Encoder, batches
from tests.llm import fixtures as fx

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "  a", "a  b", "a \n b", "x\x1c y", "\n a\n\n b  ", "<|endoftext|> a", "a  b", "it's  don't 'll x'", "a\n", "a\nb",
       "a \tb  c", "é ÉX", "ΣΑΣ. ΣΑΣ", "a　b c d", "İstanbul ﬁ ...", "tail ", "  x", "é ́ a"]


def plain_ids(name, texts, end=2):
    tokenizer = Tokenizer.from_file(fx.vocabulary(name))
    tokenizer.encode_special_tokens = True
    return [np.array([*e.ids, end], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("remembered", [5, 100_000])
def test_encoder_equals_the_library(name, remembered):
    texts = ODD + fx.odd_texts()
    coder, got = Encoder(name, remembered=remembered), []
    for a, b in batches(texts, 500):
        got += coder.encode(texts[a:b])
    assert got == [x.tobytes() for x in plain_ids(name, texts)]


def test_token_files_read_back(spark):
    docs = fx.documents(spark)
    got = sorted(tuple(r) for r in tokenfile.read(tokenfile.write(docs, NAMES[1], parts=4)).select("start", "n_tokens", "ids_crc32", "doc_id").collect())
    rows = docs.select("doc_id", "text").collect()
    ids = plain_ids(NAMES[1], [r.text for r in rows])
    assert Counter((r[3], r[1], r[2]) for r in got) == Counter((r.doc_id, len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, ids))
    assert [r[0] for r in got] == np.cumsum([0, *[r[1] for r in got[:-1]]]).tolist()
    order = [r[3] for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert tokenfile.read(tokenfile.write(fx.empty(spark), NAMES[1])).count() == 0


def check_packing(rows, ids, size):
    at = Counter()
    for r in rows:
        assert 0 < r.length <= size and r.offset + r.length <= size
        at[r.sequence_id] += r.length
    for s in at:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for doc, x in ids.items():
        cuts = packing.cuts(len(x), size)
        assert sorted(by[doc])[:len(cuts)] == [(k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(cuts)]
    return at


def test_packing_is_whole_and_tight(spark):
    docs = fx.documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text").collect()
    ids = dict(zip([r.doc_id for r in rows], plain_ids(NAMES[0], [r.text for r in rows])))
    for group in (50_000, 7):
        got = packing.pack(docs, NAMES[0], 256, group=group).collect()
        at = check_packing(got, ids, 256)
        assert len(got) == sum(len(packing.cuts(len(x), 256)) for x in ids.values())
        if group > 7:
            assert len(at) <= -(-sum(map(len, ids.values())) // 256) + 1
    repeated = packing.pack(fx.documents(spark), NAMES[0], 256)
    assert repeated.count() == repeated.select("uid").distinct().count() == len(got) + 1 + 2 * len(packing.cuts(len(ids[9]), 256))
    assert packing.pack(fx.empty(spark), NAMES[0]).count() == 0


def test_cuts():
    assert packing.cuts(5, 8) == [(0, 5)] and packing.cuts(8, 8) == [(0, 8)] and packing.cuts(16, 8) == [(0, 8), (8, 16)]
    assert packing.cuts(19, 8) == [(0, 3), (3, 11), (11, 19)] and packing.cuts(1, 8) == [(0, 1)]


def test_local_search_empties_bins_and_keeps_pieces():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 600).tolist()
    loose = [[i] for i in range(len(lengths))]
    found = packing.local_search([list(b) for b in loose], lengths, 100, patience=600)
    assert sorted(i for b in found for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in found)
    assert sum(sum(lengths[i] for i in b) ** 2 for b in found) > sum(x * x for x in lengths)
    assert len(found) < 0.75 * len(loose)
    first = packing.best_fit(lengths, 100)
    assert -(-sum(lengths) // 100) <= len(packing.local_search(first, lengths, 100)) <= len(packing.best_fit(lengths, 100))
    # Two for one: 6 + 3 in the place of 8 leaves room elsewhere.
    assert len(packing.local_search([[0], [1, 2], [3]], [8, 6, 3, 1], 9)) == 2


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_function():
    keys = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 500)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k) % (1 << 64), n) for k in keys]


def test_shards(spark):
    docs = fx.documents(spark)
    got = sharding.assign(docs, 8, buckets=3).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        own = [r.slot for r in got if r.shard == s]
        assert sorted(own) == list(range(len(own)))
    assert {r.grown_shard for r in got if r.grown_shard != r.shard} <= {8}
    many = sharding.assign(spark.range(20_000).selectExpr("id as doc_id", "'' as text"), 8)
    moved = many.filter("grown_shard <> shard").count() / 20_000
    assert abs(moved - 1 / 9) < 0.02
    counts = [r[1] for r in many.groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) < 1.1 * min(counts)
    assert sharding.assign(fx.empty(spark)).count() == 0
