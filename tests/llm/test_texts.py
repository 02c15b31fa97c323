"""Quality classifier, decontamination, preference formatting, and the pipeline's stages."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect

import __spark_entry__
import corpus_pipeline
from gridlens.llm import chat, decontaminate, quality
from gridlens.llm.common import stage
from tests.llm import fixtures as fx
from tests.llm.test_copies import plain_components, plain_fingerprint, plain_lines
from tests.llm.test_store import check_packing, plain_ids

needs_tables = pytest.mark.skipif(not os.path.isdir(fx.SF), reason="no test tables")


def plain_features(text):
    """How many features a text has: words, pairs, repeated words, and byte n-grams inside the marks of a word."""
    words = (text or "").encode().split()
    grams = sum(max(len(w) + 2 - n + 1, 0) for w in words for n in quality.GRAMS)
    return len(words) + max(len(words) - 1, 0) + sum(a == b for a, b in zip(words, words[1:])) + grams


def test_features_are_counted_whole():
    texts = ["", None, "a", "one two two three", "héé\nÀ  b", "x " * 50]
    for text, (keys, counts) in zip(texts, quality.bags(pa.array(texts))):
        assert counts.sum() == plain_features(text) and len(set(keys.tolist())) == len(keys)
    same = quality.bags(pa.array(["abc def", "abc def", "abc  xyz"]))
    assert (same[0][0] == same[1][0]).all() and set(same[0][0].tolist()) & set(same[2][0].tolist())


def test_long_texts_are_scored_whole(monkeypatch):
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.1)
    text = " ".join("w%d" % k for k in rng.integers(0, 50, 4000))
    whole = model.scores(pa.array([text, "short one", "", None]))
    keys, counts = quality.bags(pa.array([text]))[0]
    logit = (model.weights[keys] * counts).sum() / counts.sum() + model.bias
    assert abs(whole[0] - 1 / (1 + np.exp(-logit))) < 1e-6
    assert whole[2] == whole[3] == 1 / (1 + np.exp(-0.1))
    monkeypatch.setattr(quality, "SEGMENT", 300)  # only the pairs across segments are missing
    assert abs(model.scores(pa.array([text]))[0] - whole[0]) < 0.02


def test_quality_learns_and_odd_rows_pass(spark):
    rng = random.Random(2)
    good = ["the %s of %s was in the %s" % tuple(rng.choice(["river", "house", "garden", "table"]) for _ in range(3)) for _ in range(80)]
    bad = ["!!! %s $$$ ###" % (" ".join([rng.choice(["buy", "win", "cash"])] * 5)) for _ in range(80)]
    rows = [(i, t, int(t in good)) for i, t in enumerate(good + bad)]
    labelled = spark.createDataFrame([*rows, (None, None, 1), (500, "", None)], "doc_id long, text string, label int")
    model = quality.train(labelled, sample=120)
    scored = quality.score(labelled, model, ["doc_id", "label"]).collect()
    assert all((r.score >= 0.5) == (r.label == 1) for r in scored if r.doc_id is not None and r.label is not None)
    docs = fx.documents(spark)
    out = quality.score(docs, model)
    assert out.columns == [*docs.columns, "_score"] and out.count() == docs.count()
    assert all(0 <= r._score <= 1 for r in out.collect())
    nothing = quality.train(labelled.filter("false"))
    assert {r.score for r in quality.score(labelled, nothing, ["doc_id"]).collect()} == {0.5}
    assert quality.score(fx.empty(spark), model, ["doc_id"]).count() == 0


@needs_tables
def test_quality_on_held_out_rows(spark):
    folder = fx.SF.replace("0.001", "0.01")
    got = __spark_entry__.queries()["op2_quality_classifier"](spark, folder).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.93


def plain_contamination(texts, items):
    windows = {}
    for item, text in items:
        w = fx.item_words(text)
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + 13]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, found = fx.item_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("small", [decontaminate.SMALL, 0])
def test_decontamination_equals_brute_force(spark, monkeypatch, small):
    """With and without broadcasts; items of one, two, three, twelve and many words, repeated words, repeated items."""
    monkeypatch.setattr(decontaminate, "SMALL", small)
    rng = random.Random(6)
    words = ["w%d" % k for k in range(12)] + ["É", "ab"]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([1, 2, 3, 12, 13, 14, 40, 40])]
    items[0], items[1] = (0, "rareword"), (1, "rare pair")
    items += [(6, items[6][1]), (9, None), (10, ""), (11, "so so so so so so so so so so so so so so so so"), (None, items[7][1]), (6, "another text of item six with more than thirteen words in it as it is long")]
    texts = fx.odd_texts() + [t for _, t in items] + ["a RAREWORD here", "Rare, pair", "so " * 40]
    for _ in range(30):
        a, b = rng.choice(items)[1] or "", " ".join(rng.choice(words) for _ in range(rng.randint(0, 300)))
        cut = a.split()[rng.randint(0, 6):]
        texts.append(b + " " + " -- ".join(cut).upper() + " " + b[:50])
    docs = fx.documents(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'clash' as item", "1 as ipos")
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, plain_contamination([r.text for r in rows], items)))
    found = decontaminate.contamination(docs, benchmark)
    got = Counter(tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == want
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(k[0] for k in want.elements() if not k[-1])
    assert decontaminate.contamination(fx.empty(spark), benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_preference_pairs(spark):
    schema = "pair_id long, turn long, role string, text string"
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "q"), (2, 1, "assistant", "same"), (3, 0, "user", "only"), (4, None, None, None), (None, 0, "user", "x")]
    rejected = [(1, 1, "assistant", "bad"), (1, 0, "user", "hi"), (1, 2, "user", "so"), (2, 0, "user", "q"), (2, 1, "assistant", "same"), (4, None, None, None), (4, 1, "assistant", "é"), (None, 0, "user", "x")]
    clash = lambda rows: spark.createDataFrame(rows, schema).selectExpr("*", "'c' as _a", "'c' as prompt")
    got = {r.pair_id: r for r in chat.preference_pairs(clash(chosen), clash(rejected)).collect()}
    one = got[1]
    assert (one.n_shared, one.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert (one.chosen, one.rejected) == ("<|assistant|>\ngood<|end|>\n", "<|assistant|>\nbad<|end|>\n<|user|>\nso<|end|>\n")
    for spans, text, learnt in ((one.chosen_spans, one.chosen, "good<|end|>"), (one.rejected_spans, one.rejected, "bad<|end|>")):
        assert [(one.prompt + text)[s.start:s.end] for s in spans] == [learnt]
    assert (got[2].n_shared, got[2].chosen, got[2].rejected, got[2].chosen_spans) == (2, "", "", [])
    assert (got[3].n_shared, got[3].prompt, got[3].rejected) == (0, "", "") and got[3].chosen == "<|user|>\nonly<|end|>\n"
    four = got[4]
    assert four.n_shared == 1 and [(four.prompt + four.rejected)[s.start:s.end] for s in four.rejected_spans] == ["é<|end|>"]
    assert got[None].n_shared == 1
    assert chat.preference_pairs(clash([]), clash([])).count() == 0


@needs_tables
@pytest.mark.parametrize("name", ["op3_benchmark_decontamination", "op6_preference_pairs"])
def test_equals_sql(spark, name):
    note, same = compare(spark, connect(fx.SF), fx.SF, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])
    assert same, note


@needs_tables
def test_pipeline_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{fx.SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    kept, before = [], docs
    for _, step in corpus_pipeline.STAGES:
        before = stage(step(spark, before, fx.SF), "tested")
        kept.append(before)
    for frame in kept[:-1]:
        assert frame.columns == docs.columns
    tables = [{r.doc_id: r.text for r in f.collect()} for f in [docs, *kept[:-1]]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{fx.SF}/labels.parquet").collect()}
    rejected = set(tables[0]) - set(tables[1])
    assert np.mean([labels[i] == (i not in rejected) for i in labels]) > 0.93
    ids = sorted(tables[1])
    gone = plain_lines([tables[1][i] for i in ids])
    assert all(tables[2][i] == "\n".join(x for at, x in enumerate(tables[1][i].split("\n")) if (k, at) not in gone) for k, i in enumerate(ids))
    label = plain_components([plain_fingerprint(tables[2][i]) for i in ids], 4)
    assert set(tables[3]) == {ids[k] for k in set(label)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{fx.SF}/benchmark.parquet").collect()]
    ids = sorted(tables[3])
    bad = plain_contamination([tables[3][i] for i in ids], items)
    assert set(tables[4]) == {i for i, x in zip(ids, bad) if not x[-1]}
    names = sorted(tables[4])
    check_packing(kept[4].collect(), dict(zip(names, plain_ids("byte_bpe_50k.json", [tables[4][i] for i in names]))), 1024)


def test_pipeline_of_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some words"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, frame in (("odd", fx.documents(spark, clashing=False)), ("empty", fx.empty(spark))):
        docs = frame
        for _, step in corpus_pipeline.STAGES:
            before, docs = docs, step(spark, docs, str(tmp_path))
            assert name == "odd" or docs.count() == 0
        assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert name == "empty" or docs.count() > 0 and before.columns == frame.columns


def test_entry_registers_all_operators():
    names = set(__spark_entry__.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11)) and "pipeline" in names
