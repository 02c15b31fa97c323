"""Suffix-array dedup: remove every byte that a repeated string of ``length`` bytes covers.

Blockwise construction over a difference cover. Of the suffixes of all texts only those at the places of a difference cover (about one in
eleven) are named first; any two equal strings have cover places at the same distance inside. Suffixes are dealt into buckets by the
leading bits of a name, and one bucket is sorted at a time, so memory is bounded by a bucket and never holds the order of all suffixes.
Names are fingerprints of bytes instead of the bytes: order inside a bucket is by fingerprint, which groups equal strings as the order of
bytes would and needs no text in the bucket.

1. Cover names. The string from a cover place to the least length that every repeat leaves behind it is named and sorted. Places whose
   name is single can't lie in a repeat and are done with (most of all).
2. Long ties. A place that is left gets the name of its long string: ``length`` bytes on and a cover period back. If that repeats, all
   starts in front of the place are repeats, without a look at them one by one: this settles the inside of long repeats, such as copies.
   Only one place of each long name goes on, so a group of copies goes on once. A name whose long strings are all equal is settled.
3. Undecided suffixes, near the ends of repeats, are sorted themselves, by the name of their ``length`` bytes.

Names that settle something have 96 bits. Texts lie in a table bucketed by parts of input partitions (a few megabytes, or one longer text), so each round reads them where they are, and only
names go to the buckets and a bit per name comes back: a name goes once per part, however often it is there, so a string that a third of
all texts share costs a bucket no more than a name per part. Nothing else moves, and every round is written before the next.

Strings don't cross texts. Null is the empty text; texts under ``length`` bytes lose nothing and keep nothing from others. Repeated rows are
repeats of each other and are removed whole (if long enough). An empty table gives no rows; other columns are ignored. Long texts are
worked through in segments.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import byte_table, mix, plain, powers, shuffle_width, stage, text_bytes
from gridlens.session import scratch

#: Perfect difference sets: every distance modulo the period is that of two members, exactly once.
COVERS = {
    3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}
#: Bytes of a part (what one task holds), of a stored block and of a segment that is hashed at once; bits of a cover name in its bucket.
PART, BLOCK, SEGMENT, SHORT = 8 << 20, 2 << 20, 1 << 20, 40
U = np.uint64
_SEEDS = ((3, 0x9E6C63D0676A9A99), (5, 0xC2B2AE3D27D4EB4F))


def cover(length: int) -> tuple[int, np.ndarray]:
    """Period and members of the largest cover whose period is at most two thirds of the length."""
    period = max(v for v in COVERS if v <= max(3, 2 * length // 3))
    return period, np.array(COVERS[period], np.int64)


class Hash:
    """Polynomial hashes of windows of a segment, from prefix sums modulo 2^64 of random byte values."""

    _tables: dict[int, tuple] = {}

    def __init__(self, data: np.ndarray, which: int):
        seed, base = _SEEDS[which]
        if which not in self._tables:
            n = SEGMENT + 4096
            self._tables[which] = byte_table(seed), powers(base, n), powers(pow(base, -1, 1 << 64), n)
        table, power, self.inverse = self._tables[which]
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(table[data] * power[:len(data)], out=self.sums[1:], dtype=U)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]


class Part:
    """Some texts of an input partition: blocks of bytes, with the cover places in them."""

    def __init__(self, table: pa.Table, length: int):
        table = table.sort_by("block")
        self.length = length
        self.period, self.members = cover(length)
        self.short = length - self.period + 1
        self.ids = [x for ids in table.column("ids").to_pylist() for x in ids]
        self.blobs = [np.frombuffer(b.as_buffer(), np.uint8) for b in table.column("blob")]
        self.sizes = [np.frombuffer(b.as_buffer(), "<i8") for b in table.column("sizes")]

    def segments(self, k: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(first, end) of the own range of places, where the bytes begin, and the bytes with all that windows need."""
        blob = self.blobs[k]
        for a in range(0, len(blob), SEGMENT - 4096):
            b = min(a + SEGMENT - 4096, len(blob))
            lo, hi = max(0, a - self.period), min(len(blob), b + self.length + 1)
            yield a, b, lo, blob[lo:hi]

    def scan(self, long: bool) -> None:
        """Cover places of all blocks: block, p (place), first and last start in front of it, short name, long name (two hashes)."""
        columns = [[] for _ in range(7)]
        for k, sizes in enumerate(self.sizes):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            many = np.maximum((sizes - self.short) // self.period + 1, 0)  # periods that may have a place
            own = np.repeat(np.arange(len(sizes)), many)
            period = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            place = (starts[own] + period * self.period)[:, None] + self.members
            own = np.repeat(own, len(self.members))
            place = place.ravel()
            first = np.maximum(starts[own], place - self.period + 1)
            fits = (place + self.short <= ends[own]) & (first + self.length <= ends[own])
            own, place, first = own[fits], place[fits], first[fits]
            last = np.minimum(place, ends[own] - self.length)
            begin, end = first, np.minimum(ends[own], place + self.length)
            for a, b, lo, data in self.segments(k):
                x, y = np.searchsorted(place, (a, b))
                if x == y:
                    continue
                p, one = place[x:y] - lo, Hash(data, 0)
                columns[0].append(np.full(y - x, k, np.int32))
                columns[1].append(place[x:y])
                columns[2].append(first[x:y])
                columns[3].append(last[x:y])
                columns[4].append(mix(one(p, p + self.short)))
                if long:
                    s, e = begin[x:y] - lo, end[x:y] - lo
                    shape = ((p - s).astype(U) << U(32) | (e - p).astype(U)) * U(0x9E3779B97F4A7C15)
                    columns[5].append(mix(one(s, e) + shape))
                    columns[6].append(mix(Hash(data, 1)(s, e) + shape).astype(np.uint32))
        kinds = (np.int32, np.int64, np.int64, np.int64, U, U, np.uint32)
        self.block, self.place, self.first, self.last, self.name, self.long, self.check = (
            np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(columns, kinds))

    def marks(self, chosen: np.ndarray) -> list[np.ndarray]:
        """Per block, which starts lie in the ranges of the chosen places."""
        out = []
        for k, blob in enumerate(self.blobs):
            own = chosen & (self.block == k)
            steps = np.bincount(self.first[own], minlength=len(blob) + 1).astype(np.int32)
            steps[:len(blob) + 1] -= np.bincount(self.last[own] + 1, minlength=len(blob) + 1).astype(np.int32)[:len(blob) + 1]
            out.append(np.cumsum(steps[:-1]) > 0)
        return out

    def suffixes(self, marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Names (two hashes) of the strings of full length at the marked starts, in order."""
        names, checks = [np.zeros(0, U)], [np.zeros(0, np.uint32)]
        for k in range(len(self.blobs)):
            for a, b, lo, data in self.segments(k):
                at = np.flatnonzero(marks[k][a:b]) + a - lo
                if len(at):
                    names.append(mix(Hash(data, 0)(at, at + self.length)))
                    checks.append(mix(Hash(data, 1)(at, at + self.length)).astype(np.uint32))
        return np.concatenate(names), np.concatenate(checks)


def unique(names: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different (name, check) pairs in order of name: names, checks, first place, number of each input, counts."""
    order = np.lexsort((checks, names)) if len(names) else np.zeros(0, np.int64)
    n, c = names[order], checks[order]
    new = np.concatenate([[True], (n[1:] != n[:-1]) | (c[1:] != c[:-1])]) if len(n) else np.zeros(0, bool)
    number = np.empty(len(n), np.int64)
    number[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    firsts = np.minimum.reduceat(order, heads) if len(heads) else heads
    return n[heads], c[heads], firsts, number, np.diff(np.append(heads, len(n)))


def slices(names: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted names; the bucket is their leading bits."""
    edges = np.searchsorted(names, np.arange(1, 1 << bits, dtype=U) << U(64 - bits)).tolist() if bits else []
    for k, (a, b) in enumerate(zip([0, *edges], [*edges, len(names)])):
        if b > a:
            yield k, a, b


def five(names: np.ndarray, bits: int) -> bytes:
    """SHORT bits of each name behind those of the bucket, five bytes each."""
    return (((names << U(bits)) >> U(64 - SHORT))[:, None].view(np.uint8)[:, :5]).tobytes()


def unfive(payload: bytes) -> np.ndarray:
    out = np.zeros((len(payload) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(payload, np.uint8).reshape(-1, 5)
    return out.view(U).ravel()


def bits_of(replies: pa.Table, kind: int, size: int) -> np.ndarray:
    """The bits of one kind that came back, in order of the names."""
    rows = sorted(((b, n, p) for k, b, n, p in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "n", "payload"))) if k == kind))
    out = [np.unpackbits(np.frombuffer(p, np.uint8))[:n] for _, n, p in rows]
    found = np.concatenate(out).astype(bool) if out else np.zeros(0, bool)
    if len(found) != size:
        raise ValueError(f"{len(found)} replies of kind {kind} for {size} names")
    return found


MESSAGE = "bucket int, kind int, part long, n long, payload binary"
_MESSAGE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])


def messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MESSAGE)], schema=_MESSAGE) if rows else _MESSAGE.empty_table()


#: Kinds of messages and replies: cover names; long names (repeated), long names (goes on); classes of a cover name (mixed); suffixes.
COVER, LONG, LEADS, MIXED, SUFFIX = range(5)


def sorted_bucket(table: pa.Table) -> pa.Table:
    """Sort the names of one bucket and tell each sender about its own."""
    kind = table.column("kind")[0].as_py()
    bucket = table.column("bucket")[0].as_py()
    table = table.sort_by("part")
    parts, sizes, payloads = (table.column(c).to_pylist() for c in ("part", "n", "payload"))
    cuts = np.cumsum([0, *sizes])
    if kind == COVER:
        names = np.concatenate([unfive(p) for p in payloads])
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        found = np.zeros(len(names), bool)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        answers = {COVER: found}
    elif kind == MIXED:
        names = np.concatenate([unfive(p[:5 * n]) for p, n in zip(payloads, sizes)])
        longs = np.concatenate([np.frombuffer(p[5 * n:], "<u8") for p, n in zip(payloads, sizes)])
        order = np.lexsort((longs, names))
        a, w = names[order], longs[order]
        heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        low, high = w[heads], w[np.append(heads[1:], len(a)) - 1]
        mixed = (low != high) | (low == 0)
        found = np.empty(len(a), bool)
        found[order] = np.repeat(mixed, np.diff(np.append(heads, len(a))))
        answers = {MIXED: found}
    else:
        names = np.concatenate([np.frombuffer(p[:8 * n], "<u8") for p, n in zip(payloads, sizes)])
        checks = np.concatenate([np.frombuffer(p[8 * n:], "<u4") for p, n in zip(payloads, sizes)])
        _, _, firsts, number, counts = unique(names, checks)
        answers = {kind: (counts > 1)[number]}
        if kind == LONG:  # the first of a name goes on
            leads = np.zeros(len(names), bool)
            leads[firsts] = True
            answers[LEADS] = leads
    return messages([(bucket, k, part, n, np.packbits(v[a:b]).tobytes())
                     for k, v in answers.items() for part, n, a, b in zip(parts, sizes, cuts, cuts[1:])])


class State:
    """What a partition knows after the rounds whose replies it has."""

    def __init__(self, part: Part, replies: pa.Table, bits: int, done: int):
        self.part, self.bits = part, bits
        part.scan(long=done > 0)
        self.names, self.number, self.counts = np.unique(part.name, return_inverse=True, return_counts=True)
        if done > 0:
            again = (bits_of(replies, COVER, len(self.names)) | (self.counts > 1))[self.number]
            self.left = np.flatnonzero(again)
            self.longs, self.checks, firsts, self.long_number, counts = unique(part.long[self.left], part.check[self.left])
            self.first_left = self.left[firsts]
            classes = np.unique(self.number[self.left])
            self.classes, self.class_names = classes, self.names[classes]
            self.class_of = np.searchsorted(classes, self.number[self.left])
            self.counts_long = counts
        if done > 1:
            self.repeated = (bits_of(replies, LONG, len(self.longs)) | (self.counts_long > 1))[self.long_number]
            leads = bits_of(replies, LEADS, len(self.longs))
            mixed = bits_of(replies, MIXED, len(self.classes))
            chosen = np.zeros(len(part.name), bool)
            chosen[self.first_left[leads]] = True
            chosen[self.left[~mixed[self.class_of]]] = False
            self.marks = part.marks(chosen)
            names, checks = part.suffixes(self.marks)
            self.suffixes, self.suffix_checks, _, self.suffix_number, self.suffix_counts = unique(names, checks)
        if done > 2:
            found = (bits_of(replies, SUFFIX, len(self.suffixes)) | (self.suffix_counts > 1))[self.suffix_number]
            settled = np.zeros(len(part.name), bool)
            settled[self.left[self.repeated]] = True
            self.starts = part.marks(settled)
            at = 0
            for k, mark in enumerate(self.marks):
                places = np.flatnonzero(mark)
                self.starts[k][places[found[at:at + len(places)]]] = True
                at += len(places)

    def ask(self, number: int, done: int) -> pa.Table:
        rows = []
        if done == 0:
            rows = [(b, COVER, number, y - x, five(self.names[x:y], self.bits)) for b, x, y in slices(self.names, self.bits)]
        elif done == 1:
            rows = [(b, LONG, number, y - x, self.longs[x:y].tobytes() + self.checks[x:y].tobytes()) for b, x, y in slices(self.longs, self.bits)]
            low = np.full(len(self.classes), np.iinfo(np.uint64).max, U)
            high = np.zeros(len(self.classes), U)
            longs = self.part.long[self.left]
            np.minimum.at(low, self.class_of, longs)
            np.maximum.at(high, self.class_of, longs)
            only = np.where(low == high, np.maximum(low, U(1)), U(0))  # 0: several long names here already
            rows += [(b, MIXED, number, y - x, five(self.class_names[x:y], self.bits) + only[x:y].astype("<u8").tobytes())
                     for b, x, y in slices(self.class_names, self.bits)]
        elif done == 2:
            rows = [(b, SUFFIX, number, y - x, self.suffixes[x:y].tobytes() + self.suffix_checks[x:y].tobytes())
                    for b, x, y in slices(self.suffixes, self.bits)]
        return messages(rows)

    def results(self) -> pa.Table:
        """Rows of the texts: bytes, removed bytes, maximal removed runs, the kept bytes."""
        part, rows, at = self.part, [], 0
        for k, sizes in enumerate(part.sizes):
            blob, starts = part.blobs[k], self.starts[k]
            places = np.flatnonzero(starts)
            steps = np.zeros(len(blob) + 1, np.int32)
            steps[places] += 1
            np.subtract.at(steps, places + part.length, 1)
            gone = np.cumsum(steps[:-1]) > 0
            x = 0
            for size in sizes.tolist():
                own, text = gone[x:x + size], blob[x:x + size]
                n = int(own.sum())
                spans = int((own[1:] & ~own[:-1]).sum()) + int(own[0]) if n else 0
                kept = text if not n else text[~own]
                rows.append((part.ids[at], size, n, spans, hashlib.sha256(kept.tobytes()).hexdigest(), kept.tobytes().decode("utf-8", "replace")))
                at, x = at + 1, x + size
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT) if rows else _RESULT.empty_table()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])


def blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """The texts in blocks, in a table bucketed by part: later rounds read it without moving it."""
    spark = docs.sparkSession

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId() << 24, 0, 0
        for frame in frames:
            data, offsets = text_bytes(frame.column(1))
            ids, sizes = frame.column(0).to_pylist(), np.diff(offsets)
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK)) - 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part], pa.int64()), pa.array([number], pa.int32()), pa.array([ids[a:b]], pa.list_(pa.int64())),
                    pa.array([sizes[a:b].astype("<i8").tobytes()], pa.binary()), pa.array([data[offsets[a]:offsets[b]].tobytes()], pa.binary()),
                ], names=["part", "block", "ids", "sizes", "blob"])
                a, number, held = b, number + 1, held + int(offsets[b] - offsets[a])
                if held >= PART:
                    part, held = part + 1, 0

    made = plain(docs).mapInArrow(run, "part long, block int, ids array<bigint>, sizes binary, blob binary")
    name = f"gridlens_blocks_{uuid.uuid4().hex}"
    made.write.bucketBy(buckets, "part").option("compression", "zstd").option("path", scratch(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the text that is left (bytes cut inside a character show as U+FFFD)."""
    width = shuffle_width(docs.sparkSession)
    bits = max(1, (2 * width - 1).bit_length())
    table = blocks(docs, width)

    def first(group: pa.Table) -> pa.Table:
        return State(Part(group, length), _MESSAGE.empty_table(), bits, 0).ask(group.column("part")[0].as_py(), 0)

    def after(done: int):
        def later(group: pa.Table, answers: pa.Table) -> pa.Table:
            state = State(Part(group, length), answers, bits, done)
            return state.results() if done == 3 else state.ask(group.column("part")[0].as_py(), done)

        return later

    def answered(asked: DataFrame, name: str) -> DataFrame:
        return stage(asked.repartition(width, "bucket", "kind").groupBy("bucket", "kind").applyInArrow(sorted_bucket, MESSAGE), name)

    replies = answered(table.groupBy("part").applyInArrow(first, MESSAGE), "cover-names")
    for done in (1, 2):
        both = table.groupBy("part").cogroup(replies.groupBy("part"))
        replies = replies.unionByName(answered(both.applyInArrow(after(done), MESSAGE), f"suffix-names-{done}"))
    return table.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(after(3), RESULT)
