"""Small tables with every odd case, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

import public_tokenizers

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ["_id", "_row", "_h", "fp", "score", "at", "line", "uid", "pos", "item", "part", "block", "key", "mask", "value", "first", "_c", "_n", "w", "whole", "length"]


def vocabulary(name):
    return public_tokenizers.path(name)


def odd_texts(seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(60)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = prose(70)
    texts = [None, "", " ", "\n\n", "a", "Ünïcödé ÀÉ", "a\tb  c\n d", prose(30), prose(30), shared, "x " + shared, shared + " y\n" + prose(40), prose(3000)]
    texts += [prose(rng.randint(1, 120)) for _ in range(20)]
    texts += [texts[8], texts[8], texts[13] + " z", "zz zz zz zz zz zz zz zz", "q" * 5000]
    texts += [prose(12) + "\nCopyright 20%02d by the authors of this page\n" % k + prose(15) for k in range(8)]
    return texts


def documents(spark, texts=None, clashing=True, parts=3):
    """Odd texts as documents: a null id, a repeated row, and clashing extra columns."""
    texts = odd_texts() if texts is None else texts
    rows = [(i, t, "en", "s%d" % (i % 3), None if t is None else len(t)) for i, t in enumerate(texts)]
    if len(rows) > 9:
        rows += [(None, "a text without an id and some more words behind it", None, None, None), rows[9], rows[9]]
    frame = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        frame = frame.select("*", *[F.lit("clash").alias(c) for c in CLASHING])
    return frame.repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))


def signed(x):
    return x - (1 << 64) if x >> 63 else x
