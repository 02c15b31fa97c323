"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. On a level, runs of equal symbols count as one; deterministic coin tossing gives every run a small label
that depends on itself and a few neighbours to its left: the place and value of the lowest bit in which it differs from its neighbour, taken
again until labels are below 6. Runs whose label is a local maximum begin phrases, and a phrase's name, a hash of its symbols, is a symbol
of the next level. Names so depend on the content around them and not on the offset: equal substrings have equal phrases but for a few at their ends.

The fingerprint of a text is a sketch of its names on two levels (about 10 and 30 bytes long): the ``SIZE`` least hashes of the set, 8 hexadecimal
digits each, in ascending order. The likeness of two fingerprints is the share of common hashes among the least of both, an estimate of
the share of common phrases (exact for texts of few phrases); two fingerprints without phrases are alike.

Null is the empty text, whose fingerprint is empty. Equal texts have equal fingerprints. Texts are parsed whole in one task; a
text needs memory in proportion to its own length, and many texts are parsed together. Repeated rows and ids keep a row each.
An empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import byte_table, mix, plain, powers, shuffle_width, stage

SIZE, LEVELS, FIRST = 64, 3, 2
U = np.uint64
_TABLE, _POWERS = byte_table(11), powers(0xD1342543DE82EF95, 4096)
_STEP, _SHORT = U(0x632BE59BD9B4E019), 16
#: Mixed values of short runs of bytes: byte times _SHORT plus length.
_RUNS = mix(np.repeat(_TABLE, _SHORT) + np.tile(np.arange(_SHORT, dtype=U), 256) * _STEP)
_LOWEST = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round on labels below 256: twice the lowest differing bit, plus the own bit there."""
    differ = np.empty_like(label)
    differ[0] = 1
    np.bitwise_xor(label[1:], label[:-1], out=differ[1:])
    differ[first] = 1  # a text's first symbol has no neighbour
    low = _LOWEST[differ]
    return (low << 1) | ((label >> low) & 1)


def parse(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level, and whether each is the first of a text.

    ``symbols`` are bytes or 64-bit names of texts in a row; ``first`` marks where texts begin.
    """
    change = np.empty(len(symbols), bool)
    change[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=change[1:])
    heads = np.flatnonzero(change | first)
    run, start = symbols[heads], first[heads]
    if run.dtype != np.uint8:  # 64 bits to labels below 128
        differ = run.copy()
        differ[1:] ^= run[:-1]
        differ[start] = 1
        low = np.bitwise_count((differ & (~differ + U(1))) - U(1)).astype(np.uint8)
        label = (low << 1) | ((run >> low.astype(U)) & U(1)).astype(np.uint8)
        rounds = 3
    else:
        label, rounds = run, 3
    at = np.flatnonzero(start)
    for _ in range(rounds):
        label = _toss(label, at)
    top = np.ones(len(label), bool)
    top[1:] &= label[1:] > label[:-1]
    top[:-1] &= label[:-1] > label[1:]
    top[-1] = False
    top[np.maximum(at[1:] - 1, 0)] = False  # a text's last run begins no phrase: its right neighbour isn't known
    top[at] = True
    begin = np.flatnonzero(top).astype(np.int32)
    length = np.diff(heads, append=len(symbols))
    place = np.arange(len(run), dtype=np.int32) - np.repeat(begin, np.diff(begin, append=len(run)))
    if run.dtype == np.uint8 and int(length.max()) < _SHORT:
        value = _RUNS[run.astype(np.uint16) * _SHORT + length.astype(np.uint16)]
    else:
        value = mix((_TABLE[run] if run.dtype == np.uint8 else run) + length.astype(U) * _STEP)
    factor = _POWERS[place if int(place.max()) < len(_POWERS) else np.minimum(place, len(_POWERS) - 1)]
    names = mix(np.add.reduceat(value * factor, begin) + U(1))
    return names, start[begin]


def sketches(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """The least 32-bit hashes of the phrase names of each text, ascending."""
    lengths = np.array([len(t) for t in texts], np.int64)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    present = np.flatnonzero(lengths)
    if not len(present):
        return out
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    first = np.zeros(len(symbols), bool)
    first[np.concatenate([[0], np.cumsum(lengths[present])[:-1]])] = True
    owners, hashes = [], []
    for level in range(1, LEVELS + 1):
        symbols, first = parse(symbols, first)
        if level >= FIRST:
            owners.append(np.cumsum(first) - 1)
            hashes.append((mix(symbols ^ U(level)) >> U(32)).astype(np.uint32))
    key = (np.concatenate(owners).astype(U) << U(32)) | np.concatenate(hashes)
    key = np.unique(key)
    owner = (key >> U(32)).astype(np.int64)
    edges = np.searchsorted(owner, np.arange(len(present) + 1))
    low = key.astype(np.uint32)
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        out[int(present[k])] = low[a:min(b, a + size)]
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of common hashes among the least of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    again = both[1:] == both[:-1]  # hashes of one text differ
    least = both[np.concatenate([[True], ~again])][:size]
    return float((both[1:][again] <= least[-1]).sum() / len(least))


def shown(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            names, texts = frame.column(0), [(t or "").encode() for t in frame.column(1).to_pylist()]
            found = [shown(s) for a, b in spans([len(t) for t in texts]) for s in sketches(texts[a:b], size)]
            yield pa.RecordBatch.from_arrays([names, pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return plain(docs).mapInArrow(run, "doc_id long, fingerprint string")


def spans(lengths: list[int], at_once: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= at_once:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
#: What a partition writes: finished rows (kind 0), its first text (1) and its last row, which waits for another partition's first text (2).
_WRITTEN = COLUMNS + ", kind int, part int, text string"


def edit(text: str, other: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many code points from the front of ``other``, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


def compared(ids: list, texts: list[str], nexts: list[str], size: int = SIZE) -> pa.RecordBatch:
    """Finished rows of texts and the text that follows each."""
    edited = [edit(t, o) for t, o in zip(texts, nexts)]
    different = list(dict.fromkeys([*texts, *nexts, *edited]))
    coded = [t.encode() for t in different]
    found = dict(zip(different, (s for a, b in spans([len(c) for c in coded]) for s in sketches(coded[a:b], size))))
    columns = [
        ids, [len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edited], [shown(found[t]) for t in texts],
        [shown(found[e]) for e in edited], [likeness(found[t], found[e], size) for t, e in zip(texts, edited)],
        [likeness(found[t], found[o], size) for t, o in zip(texts, nexts)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def with_edits(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Every row against its edited text and the next document, in descending order of doc_id (after the last comes the first).

    Texts move once, into ranges of ids. Inside a range the next text is the next row; the last row of a range and the first text of each
    are written too, and meet in a small join. Equal ids are ordered by a hash of the text, null ids come last.
    """
    spark = docs.sparkSession
    rows = plain(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h").asc()]
    rows = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    fields = [*_SCHEMA, pa.field("kind", pa.int32()), pa.field("part", pa.int32()), pa.field("text", pa.string())]
    schema = pa.schema(fields)

    def edge(kind: int, part: int, doc_id, text: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"doc_id": doc_id, "kind": kind, "part": part, "text": text}], schema=schema)

    def finished(done: pa.RecordBatch, part: int) -> pa.RecordBatch:
        n = done.num_rows
        return pa.RecordBatch.from_arrays([*done.columns, pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())], schema=schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = TaskContext.get().partitionId(), None
        for frame in frames:
            ids, texts = frame.column(0).to_pylist(), frame.column(1).to_pylist()
            if not ids:
                continue
            if waiting is None:
                yield edge(1, part, None, texts[0])
            else:
                ids.insert(0, waiting[0])
                texts.insert(0, waiting[1])
            for a, b in spans([len(t) for t in texts[:-1]], 1 << 20):
                yield finished(compared(ids[a:b], texts[a:b], texts[a + 1:b + 1], size), part)
            waiting = ids[-1], texts[-1]
        if waiting is not None:
            yield edge(2, part, *waiting)

    written = stage(rows.mapInArrow(run, _WRITTEN), "fingerprint-rows")
    parts = sorted(r.part for r in written.filter("kind = 2").select("part").collect())  # one number per range
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    heads = written.filter("kind = 1").select(F.col("part").alias("after"), F.col("text").alias("next"))
    open_rows = written.filter("kind = 2").select("part", "doc_id", "text").join(after, "part").join(heads, "after").select("doc_id", "text", "next")

    def last(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for k in range(frame.num_rows):
                a, b, c = (frame.column(i)[k].as_py() for i in range(3))
                yield compared([a], [b], [c], size)

    names = [f.name for f in _SCHEMA]
    return written.filter("kind = 0").select(*names).unionByName(open_rows.mapInArrow(last, COLUMNS))
