"""Quality classifier: supervised subword embeddings.

A text is a bag of hashed features: its words, its pairs of neighbouring words, and the byte n-grams of its words between boundary marks.
Each feature has a learned vector; the vectors of a text are averaged and a softmax layer tells the classes apart. Vectors and layer are
trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows (``sample``, the rows with the least
hash of their id), with classes weighted to equal shares. A word that follows itself
is also a feature of its own, the same for all words. Features are made by Spark tasks, the descent runs in one task, and the trained
model, whose size is fixed, is sent to all tasks that score.

The average and the layer are linear, so a trained model has one number per feature, and a text is scored in one pass over its bytes.

Null and empty texts have no features and get the score of the bias. Texts are scored whole, however long: their bytes are worked through in
segments cut at white space, whose sums are added. Rows with a null label are not learnt from; without any labelled row, or with one class,
every score is 0.5 or the share of that class. Repeated rows keep a row each. An empty table gives no rows. Clashing extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import byte_table, mix, powers, stage, text_bytes

#: Hashed features (2^BITS), width of the vectors, byte n-grams, labelled rows that the descent sees, passes over them, step at the start.
BITS, WIDTH, GRAMS, SAMPLE, EPOCHS, RATE = 17, 12, (3, 4, 5), 4000, 6, 0.3
#: Bytes that are turned into features at once.
SEGMENT = 1 << 19
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = byte_table(7)
_POWERS = powers(_BASE, SEGMENT + 64)
_INVERSE = powers(pow(_BASE, -1, 1 << 64), SEGMENT + 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def features(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of texts that each begin and end with a blank, and the text of each feature."""
    blank = _BLANK[data]
    code = _TABLE[np.where(blank, 32, data)]
    head = np.concatenate([np.zeros(1, U), np.cumsum(code * _POWERS[:len(code)], dtype=U)])
    shift, found, places = U(64 - BITS), [], []

    def hashed(a: np.ndarray, b: np.ndarray, kind: int) -> None:
        found.append((mix((head[b] - head[a]) * _INVERSE[a] + U(kind)) >> shift).astype(np.int32))
        places.append(owner[a])

    inner = np.cumsum(blank)
    n = len(data)
    for size in GRAMS:  # blanks may only be the marks at both ends
        if n >= size:
            a = np.flatnonzero((inner[size - 2:n - 1] - inner[:n - size + 1] == 0) if size > 2 else np.ones(n - size + 1, bool))
            hashed(a, a + size, size)
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    hashed(start, end, 101)
    pair = np.flatnonzero(owner[start[:-1]] == owner[start[1:]])
    hashed(start[pair], end[pair + 1], 102)
    words = found[-2]  # a word beside itself is one feature, whichever word it is
    again = pair[words[pair] == words[pair + 1]]
    found.append(np.full(len(again), 1, np.int32))
    places.append(owner[start[again]])
    return np.concatenate(found), np.concatenate(places)


def segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, text number of every byte) of many texts, each between blanks, in runs of bounded length.

    A longer text is cut at its last blank in reach, or anywhere if there is none.
    """
    parts, owners, size = [], [], 0
    pad = np.array([32], np.uint8)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while a < b:
            c = min(b, a + SEGMENT - 2)
            if c < b:
                blanks = np.flatnonzero(_BLANK[data[a:c]])
                c = a + int(blanks[-1]) + 1 if len(blanks) and blanks[-1] else c
            if size + c - a + 2 > SEGMENT:
                yield np.concatenate(parts), np.concatenate(owners)
                parts, owners, size = [], [], 0
            parts += [pad, data[a:c], pad]
            owners.append(np.full(c - a + 2, k, np.int32))
            size += c - a + 2
            a = c
    if parts:
        yield np.concatenate(parts), np.concatenate(owners)


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, counts) of each text."""
    data, offsets = text_bytes(texts)
    found: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for part, owner in segments(data, offsets):
        feature, at = features(part, owner)
        key = (at.astype(np.int64) << BITS) | feature
        keys, counts = np.unique(key, return_counts=True)
        cuts = np.flatnonzero(np.diff(keys >> BITS)) + 1
        for ks, cs in zip(np.split(keys, cuts), np.split(counts, cuts)):
            if len(ks):
                found[int(ks[0] >> BITS)].append(np.stack([ks & ((1 << BITS) - 1), cs]))
    out = []
    for pieces in found:
        if len(pieces) == 1:
            out.append((pieces[0][0], pieces[0][1]))
        elif pieces:
            both = np.concatenate(pieces, axis=1)
            ks, back = np.unique(both[0], return_inverse=True)
            out.append((ks, np.bincount(back, both[1]).astype(np.int64)))
        else:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return out


@dataclass
class Model:
    """A number per feature and a bias: the difference of the two classes' outputs."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for part, owner in segments(data, offsets):
            feature, at = features(part, owner)
            total += np.bincount(at, self.weights[feature], len(texts))
            count += np.bincount(at, minlength=len(texts))
        logit = np.clip(total / np.maximum(count, 1) + self.bias, -700, 700)
        return 1 / (1 + np.exp(-logit))


def descend(rows: list[tuple[np.ndarray, np.ndarray, int]], width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Train vectors and layer on (features, counts, label) rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (1 << BITS, width)).astype(np.float32)
    layer, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    share = [max(1, sum(y == c for *_, y in rows)) for c in (0, 1)]
    if not rows:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    weight = [len(rows) / (2 * s) for s in share]
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            keys, counts, y = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            if len(keys):
                part = (counts / counts.sum()).astype(np.float32)
                hidden = part @ vectors[keys]
            else:
                hidden = np.zeros(width, np.float32)
            out = hidden @ layer + bias
            out = np.exp(out - out.max())
            error = (out / out.sum() - np.eye(2, dtype=np.float32)[y]) * min(weight[y], 8)
            back = layer @ error
            layer -= lr * np.outer(hidden, error)
            bias -= lr * error
            if len(keys):
                vectors[keys] -= (lr * part[:, None] * len(keys) ** 0.5) * back
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def train(labelled: DataFrame, sample: int = SAMPLE, **settings) -> Model:
    """A model from rows of doc_id, text and label (0 or 1). Only the ``sample`` rows with the least hash of doc_id are learnt from."""
    chosen = labelled.filter("label is not null").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    chosen = chosen.withColumn("_h", F.xxhash64("doc_id", F.lit(17)))
    edge = stage(chosen.select("_h").orderBy("_h").limit(sample), "quality-sample").agg(F.max("_h")).first()[0]
    if edge is None:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    chosen = chosen.filter(F.col("_h") <= edge).select("_h", "text", "label")

    def bagged(frames: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = bags(frame.column(1))
            yield pa.RecordBatch.from_arrays([
                frame.column(0), frame.column(2), pa.array([k.astype("<u4").tobytes() for k, _ in found], pa.binary()),
                pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary()),
            ], names=["h", "label", "keys", "counts"])

    rows = stage(chosen.mapInArrow(bagged, "h long, label int, keys binary, counts binary"), "quality-features")

    def trained(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "label", "keys"]).head(sample)
        model = descend([(np.frombuffer(k, "<u4").astype(np.int64), np.frombuffer(c, "<u4").astype(np.int64), int(y))
                         for k, c, y in zip(frame["keys"], frame["counts"], frame["label"])], **settings)
        return pd.DataFrame({"weights": [model.weights.astype("<f4").tobytes()], "bias": [model.bias]})

    held = rows.groupBy(F.lit(0).alias("one")).applyInPandas(trained, "weights binary, bias double").first()
    return Model(np.frombuffer(held.weights, "<f4"), held.bias)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all of them if not given) and a score; the text column may be among them."""
    keep = docs.columns if keep is None else keep
    name = "score"
    while name in keep:
        name = "_" + name
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers, whatever the data

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            kept = [frame.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sent.value.scores(frame.column(len(keep))))], names=[*keep, name])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_whole_text"))
    schema = rows.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.5).alias(name)).schema
    return rows.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def learn_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and label of the labelled rows outside the held-out fold."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    marked = marked.filter("label is not null and doc_id is not null").filter(fold(F.col("doc_id")) != 1)
    edge = F.xxhash64("doc_id", F.lit(17))
    least = marked.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("_h", edge).orderBy("_h").limit(4 * SAMPLE).select("doc_id", "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(least), "doc_id")  # at most 4 * SAMPLE pairs of numbers
