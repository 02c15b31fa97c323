"""Suffix dedup, SimHash near-duplicates, components, line templates, fingerprints."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from gridlens.llm import components, fingerprint, lines, simhash, suffixes
from tests.llm import fixtures as fx


def plain_repeats(texts, length):
    coded = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in coded for i in range(len(b) - length + 1))
    out = []
    for b in coded:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def texts_with_repeats(seed, n=60):
    rng = random.Random(seed)
    source = "".join(rng.choice("ab cdé") for _ in range(3000))
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randrange(len(source))
            parts.append(source[a:a + rng.randint(1, 400)])
            parts.append("".join(rng.choice("xyz") for _ in range(rng.randint(0, 60))))
        out.append("".join(parts))
    return out + out[:3] + ["a" * 700, "b" * 450, None]


@pytest.mark.parametrize("length", [20, 64, 200])
def test_suffix_dedup_equals_brute_force(spark, length):
    for seed, parts in ((1, 1), (2, 5)):
        texts = texts_with_repeats(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
        got = {r.doc_id: tuple(r)[1:5] for r in suffixes.without_repeats(docs, length).collect()}
        assert [got[i] for i in range(len(texts))] == plain_repeats(texts, length)


def test_suffix_dedup_odd_rows(spark):
    docs = fx.documents(spark)
    texts = [r.text for r in docs.collect()]
    got = suffixes.without_repeats(docs).collect()
    want = plain_repeats(texts, 200)
    assert Counter(tuple(r)[1:5] for r in got) == Counter(want)
    assert suffixes.without_repeats(fx.empty(spark)).count() == 0


def test_suffix_segments(spark, monkeypatch):
    """A text longer than a segment is one text."""
    rng = random.Random(5)
    part = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    filler = "".join(rng.choice("abcdefgh ") for _ in range((1 << 20) - 5000))
    texts = [filler + part + filler[:10], part, "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.without_repeats(docs).collect()}
    assert got == {0: (1500, 1), 1: (1500, 1), 2: (0, 0)}


def test_covers_hold_every_distance():
    for period, members in suffixes.COVERS.items():
        assert {(a - b) % period for a in members for b in members} == set(range(period))


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", fx.lower_ascii(text))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius):
    label = list(range(len(values)))
    changed = True
    near = [[j for j in range(len(values)) if (values[i] ^ values[j]).bit_count() <= radius] for i in range(len(values))]
    while changed:
        changed = False
        for i, js in enumerate(near):
            least = min(label[j] for j in js)
            for j in js:
                if label[j] != least:
                    label[j], changed = least, True
    return label


def test_near_counts_bits():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for b in range(7):
        values[b * 10:b * 10 + 10] = values[100] ^ np.uint64((1 << b) - 1)
    word = np.where((values[100] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), simhash.ALL_ONES, np.uint64(0))
    for radius in range(8):
        got = simhash.members(simhash.near(simhash.planes(values), word, radius), len(values))
        assert got.tolist() == np.flatnonzero(np.bitwise_count(values ^ values[100]) <= radius).tolist()


@pytest.mark.parametrize("limit", [simhash.LIMIT, 100])
def test_links_join_all_within_the_radius(spark, limit):
    """The lower limit cuts the group that shares 32 bits once more."""
    rng = random.Random(limit)
    front = rng.getrandbits(32) << 32
    values = [rng.getrandbits(64) for _ in range(40)] + [front | rng.getrandbits(32) for _ in range(150)]
    for base in values[:6]:
        for _ in range(12):
            base ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3)))
            values.append(base)
    values = sorted(set(values))
    nodes = spark.createDataFrame([(fx.signed(v),) for v in values], "fp long")
    found = {r.fp: r._c for r in simhash.groups(nodes, 4, limit).collect()}
    label = plain_components(values, 4)
    groups = {}
    for v, c in zip(values, label):
        groups.setdefault(c, set()).add(found[fx.signed(v)])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_equals_brute_force(spark):
    docs = fx.documents(spark)
    rows = docs.select("doc_id", "text").collect()
    values = [plain_fingerprint(r.text) for r in rows]
    label = plain_components(values, 4)
    least = {}
    for r, c in zip(rows, label):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{v:016x}", least.get(c)) for r, v, c in zip(rows, values, label))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(least.values())
    assert kept.count() == len(set(label))
    assert simhash.near_duplicates(fx.empty(spark)).count() == 0 and simhash.keep_first(fx.empty(spark)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 99), (7, 7), (200, 50)]
    got = {r.node: r.least for r in components.label(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert {k: v for k, v in got.items() if k <= 40} == {i: 0 for i in range(41)}
    assert {got[k] for k in (99, 100, 101)} == {99} and got[200] == got[50] == 50


def plain_lines(rows, depth=3, documents=5, constant=0.6, similar=0.8):
    """The lines to drop per row, worked out with dictionaries."""

    def masked(line):
        tokens = re.sub("[ \t\r]+", " ", line).strip(" ").split(" ")
        if len(tokens) > 1:
            return " ".join("<*>" if re.search("[0-9]", t) else t for t in tokens)
        return re.sub("[0-9]+", "0", tokens[0]) if re.search("[^0-9]", tokens[0]) else tokens[0]

    def parsed(line):
        if " " not in line and re.search("[\u4e00-\u9fff]", line):
            return "characters", ["<*>" if x == "0" else x for x in line]
        return "words", line.split(" ")

    leaf_of, texts_of = {}, {}
    for text in {t for t in rows if t is not None}:
        for line in {masked(x) for x in text.split("\n")} - {""}:
            kind, tokens = parsed(line)
            leaf_of[line] = (kind, len(tokens), tuple(line.split(" ")[:depth] if kind == "words" else line[:depth]))
            texts_of.setdefault(line, set()).add(text)
    template = {line: line for line, of in texts_of.items() if len(of) >= documents}
    cells = {}
    rest = [line for line in texts_of if line not in template]
    for line in rest:
        for place, token in enumerate(parsed(line)[1]):
            cells.setdefault((leaf_of[line], place, token), set()).update(texts_of[line])
    for line in rest:
        tokens = parsed(line)[1]
        often = [(-len(cells[leaf_of[line], i, t]), i, t) for i, t in enumerate(tokens) if t != "<*>" and len(cells[leaf_of[line], i, t]) >= documents]
        enough = max(2, -(-len(tokens) * 6 // 10))
        if len(often) >= enough:
            template[line] = (leaf_of[line], tuple(sorted((i, t) for _, i, t in sorted(often)[:enough])))
    of = {}
    for line, t in template.items():
        of.setdefault(t, set()).update(texts_of[line])
    template = {line: t for line, t in template.items() if len(of[t]) >= documents}

    def near_copy(text):
        lines = {masked(x) for x in text.split("\n")} - {""}
        common = sum(x in template for x in lines)
        return common >= similar * (2 * len(lines) - common)

    recurs = {t for t in set(template.values()) if sum(not near_copy(x) for x in of[t]) + any(near_copy(x) for x in of[t]) >= documents}
    return {(k, at) for k, text in enumerate(rows) if text is not None for at, x in enumerate(text.split("\n")) if template.get(masked(x)) in recurs}


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    texts = fx.odd_texts()

    def own(n=9):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n))

    for k in range(30):
        body = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.choice(["", "", k])) for _ in range(rng.randint(1, 9))) for _ in range(4)]
        body.insert(rng.randrange(5), "Share this page with %s friends now" % rng.choice(["your", "all", "many", "few", "good"]))
        if k % 3:
            body.insert(rng.randrange(6), "Terms of use  apply")
        texts.append("\n".join(body))
    texts += ["one line\nthat all the copies have\nand a third one"] * 8
    # Near copies: kept whole, whatever their number; but a line that they share with four other documents goes.
    page = [own() for _ in range(11)]
    texts += ["\n".join([*page[:4], own(), *page[4:], "see the imprint of this page"]) for _ in range(9)]
    texts += ["\n".join([own(), own(), "see the imprint of this page"]) for _ in range(4)]
    # Two families of one leaf with values that are frequent themselves, one with too few documents, and a line that one document repeats.
    for k in range(12):
        texts.append("\n".join([own(), "we thank our %s readers in %s for letters" % ("good" if k % 2 else own(1), rng.choice(["rome", "oslo", own(1)]))]))
        texts.append("\n".join([own(), "we thank our friends who sent %s last week" % own(1)]))
    texts += ["\n".join([own(), "we hope that %s comes back soon" % own(1)]) for _ in range(4)] + ["\n".join([own()] + ["again and again and again"] * 9)]
    texts += ["第" + str(k) + "章版权所有" + x + "本站保留一切权利\n" + own() for k, x in enumerate("赵钱孙李周吴郑")]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_lines(texts)
    gone = {texts[k].split("\n")[at].split(" ")[0] for k, at in want}
    assert {"Share", "Terms", "see", "we"} <= gone and not gone & {"one", "again", page[0].split(" ")[0]}
    got = {r.doc_id: r for r in lines.dropped(docs).select("_held.doc_id", "_lines.n", "_lines.out", "_lines.text").collect()}
    for i, t in enumerate(texts):
        every = [] if t is None else t.split("\n")
        left = [x for at, x in enumerate(every) if (i, at) not in want]
        assert got[i].out == len(every) - len(left), (i, t)
        assert got[i].text == (None if t is None else "\n".join(left))
        assert got[i].n == len(every)


def test_lines_odd_rows(spark):
    docs = fx.documents(spark)
    out = lines.clean(docs, min_documents=4)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = [r.text for r in out.collect() if r.text and "authors" in r.text]
    assert not texts  # the year is a variable field, so the eight lines are one template
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None and r.n_chars is not None)
    assert lines.clean(fx.empty(spark)).count() == 0


def test_fingerprints_against_the_next_document(spark):
    docs = fx.documents(spark)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    got = fingerprint.with_edits(docs).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for k, r in enumerate(rows):
        text, other = r.text or "", rows[(k + 1) % len(rows)].text or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        own = by_id[r.doc_id]
        assert all(x.n_chars == len(text) for x in own)
        assert hashlib.sha256(edited.encode()).hexdigest() in {x.edited_sha256 for x in own}
        a, b, c = fingerprint.sketches([text.encode(), edited.encode(), other.encode()])
        assert (fingerprint.shown(a), fingerprint.shown(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c)) in {
            (x.fingerprint, x.edited_fingerprint, x.near_edited, x.near_next) for x in own}
    assert fingerprint.with_edits(fx.empty(spark)).count() == 0
    assert {(r.doc_id, r.fingerprint) for r in fingerprint.fingerprints(docs).collect()} == {(r.doc_id, r.fingerprint) for r in got}


def test_parsing_is_locally_consistent():
    rng = random.Random(9)
    body = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    for shift in (1, 7, 50, 333):
        front = "".join(rng.choice("klmnop ") for _ in range(shift))
        a, b = fingerprint.sketches([body.encode(), (front + body).encode()], 10_000)
        assert len(np.intersect1d(a, b)) > 0.95 * len(a)
    one = fingerprint.sketches([body.encode(), b"", b"a" * 9000, b"ab" * 4000, body.encode()])
    assert one[0].tolist() == one[4].tolist() and not len(one[1]) and 0 < len(one[2]) <= 4 and 0 < len(one[3]) <= 8
    assert fingerprint.likeness(one[0], one[4]) == 1 and fingerprint.likeness(one[0], one[1]) == 0 and fingerprint.likeness(one[1], one[1]) == 1


def test_likeness_follows_common_phrases():
    rng = random.Random(10)
    a, b = ("".join(rng.choice("abcdefghij ") for _ in range(20_000)) for _ in range(2))
    for share in (0, 0.25, 0.5, 0.9):
        n = int(share * len(a))
        x, y = fingerprint.sketches([a.encode(), (a[:n] + b[n:]).encode()])
        assert abs(fingerprint.likeness(x, y) - share / (2 - share)) < 0.2
