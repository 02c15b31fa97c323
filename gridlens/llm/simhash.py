"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits; bit i is set if it is set in over half of the XXH64 values of a text's word shingles. Two fingerprints link
if at most ``radius`` bits differ, and linked texts share a component.

Only different fingerprints are compared. Candidates share the bits of a mask: the free bits are cut into radius + 2 blocks, and two
fingerprints within the radius agree on two blocks at least, so each pair within it meets under one of the pairs of blocks. A mask
value shared by more than ``LIMIT`` fingerprints is cut again by its free bits, until groups are small; this ends, for a group with 16
free bits can't hold more. Groups are compared bit-sliced: bit planes are stored vertically, 64 fingerprints a word, carry-save
counters add up the differing planes of all of them at once, and a block is abandoned when every counter is beyond the radius.
A group reports a spanning forest of its links, not its pairs.

Null and empty texts have no words and the fingerprint zero, linked like any other. Repeated rows and ids keep a row each. A null
doc_id never names a component unless it has no other id. An empty table gives no rows; other columns are ignored. Texts of any length
are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm import components
from gridlens.llm.common import plain, row_key, shuffle_width, stage

RADIUS, WORDS, SEED = 4, 4, 42
#: Fingerprints of one mask value that a task compares; a larger group is cut by more bits.
LIMIT = 1 << 16
ALL_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64 bits of one text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = list(accumulate(map(len, parts), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    spans = zip(starts, ends[words - 1:]) if len(parts) >= words else [(0, len(joined))]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in spans), ">u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def with_fingerprint(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows of a key and a text become rows of the key and fp (the fingerprint as a signed 64-bit number)."""
    key = rows.columns[0]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            values = np.array([fingerprint(t, words) for t in frame.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(values)], names=[key, "fp"])

    return rows.mapInArrow(run, rows.select(key, F.lit(0).cast("long").alias("fp")).schema)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp of every row."""
    return with_fingerprint(plain(docs), words)


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows of words: row b holds bit b of 64 fingerprints a word; padded with zeros."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(block: np.ndarray, other: np.ndarray, radius: int) -> np.ndarray:
    """Words whose bits tell where two sets of planes differ in at most ``radius`` (under 8) places.

    ``other`` has a word or a whole row of words for each plane. Three planes go through a full adder; its sum and carry are added to
    three counter planes, and a fourth keeps what has gone beyond seven.
    """
    c0, c1, c2, beyond = (np.zeros(block.shape[1], np.uint64) for _ in range(4))

    def add(bit: np.ndarray, place: int) -> None:
        nonlocal beyond
        for c in (c0, c1, c2)[place:]:
            carry = c & bit
            np.bitwise_xor(c, bit, out=c)
            bit = carry
        beyond |= bit

    def far() -> np.ndarray:  # counters over the radius, by comparing their bits with it from the top
        more, equal = np.zeros_like(c0), np.full_like(c0, ALL_ONES)
        for c, bit in ((c2, radius & 4), (c1, radius & 2), (c0, radius & 1)):
            if bit:
                equal &= c
            else:
                more |= equal & c
                equal &= ~c
        return beyond | more

    for b in range(0, 63, 3):
        x, y, z = block[b] ^ other[b], block[b + 1] ^ other[b + 1], block[b + 2] ^ other[b + 2]
        both = x ^ y
        add(both ^ z, 0)
        add((x & y) | (both & z), 1)
        if b % 12 == 9:
            beyond = far()
            if (beyond == ALL_ONES).all():
                return np.zeros_like(c0)
    add(block[63] ^ other[63], 0)
    return ~far()


def members(words: np.ndarray, n: int) -> np.ndarray:
    """Positions of the set bits among the first n."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (member, found member) that join all that are joined in a group, by search from member to member."""
    links, left = [], np.arange(len(values))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        block, held = planes(values[left]), left
        alive = np.ones(len(held), bool)
        while queue and alive.any():
            at = queue.pop()
            if alive.sum() < 0.5 * len(held):
                held, alive = held[alive], np.ones(int(alive.sum()), bool)
                block = planes(values[held])
            word = np.where((values[at] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ALL_ONES, np.uint64(0))
            found = members(near(block, word, radius), len(held))
            found = found[alive[found]]
            alive[found] = False
            for k in held[found].tolist():
                links.append((at, k))
                queue.append(k)
        left = held[alive]
    return links


def group_links(groups: np.ndarray, values: np.ndarray, radius: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups; ``groups`` numbers the rows' groups in ascending order.

    All small groups are compared together: row i against row i + shift, for every shift, on vertical planes of the whole batch.
    """
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(starts, len(groups)))
    left, right = [], []
    size_of = np.repeat(sizes, sizes)
    keep = np.flatnonzero((size_of > 1) & (size_of <= small))
    if len(keep):
        g, v = groups[keep], values[keep]
        for shift in range(1, int(size_of[keep].max())):
            rows = np.flatnonzero(g[shift:] == g[:-shift])
            for k in range(0, len(rows), 1 << 18):
                some = rows[k:k + (1 << 18)]
                hits = members(near(planes(v[some]), planes(v[some + shift]), radius), len(some))
                left.append(v[some[hits]])
                right.append(v[some[hits] + shift])
    for s, n in zip(starts.tolist(), sizes.tolist()):
        if n > small:
            own = values[s:s + n]
            found = forest(own, radius)
            if found:
                a, b = np.array(found).T
                left.append(own[a])
                right.append(own[b])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def masks(fixed: int, radius: int) -> list[int]:
    """Masks that fix two more of radius + 2 blocks of the free bits."""
    free = [b for b in range(64) if not fixed >> b & 1]
    blocks = [sum(1 << b for b in part) for part in np.array_split(np.array(free, object), radius + 2)]
    return [fixed | a | b for a, b in combinations(blocks, 2)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """src, dst: links between the different values of ``fp`` that join all fingerprints within the radius, transitively."""
    spark, width = nodes.sparkSession, shuffle_width(nodes.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)

        def compared(rows: np.ndarray) -> pa.RecordBatch:
            change = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
            groups = np.concatenate([[0], np.cumsum(change)])
            a, b = group_links(groups, rows[:, 2].view(np.uint64).copy(), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        for frame in frames:
            rows = np.column_stack([frame.column(c).to_numpy() for c in range(3)])
            held = np.concatenate([held, rows]) if len(held) else rows
            change = np.flatnonzero(np.any(held[1:, :2] != held[:-1, :2], axis=1))
            if len(change):  # the last group may go on in the next batch
                cut = int(change[-1]) + 1
                yield compared(np.ascontiguousarray(held[:cut]))
                held = held[cut:]
        if len(held):
            yield compared(np.ascontiguousarray(held))

    fixed, found, level = [0], None, 0
    rows = nodes.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        below = {m: masks(m, radius) for m in fixed}
        lookup = spark.createDataFrame([(signed(m), [signed(x) for x in c]) for m, c in below.items()], "mask long, finer array<long>")
        finer = rows.join(F.broadcast(lookup), "mask").select(F.explode("finer").alias("mask"), "fp")  # as many masks as blocks make, whatever the data
        keyed = finer.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
        counts = stage(keyed.groupBy("mask", "value").count().filter(F.col("count") > limit).select("mask", "value"), f"simhash-hot-{level}")
        hot = [r.mask for r in counts.select("mask").distinct().collect()]  # masks, not groups: as many as blocks make
        plain_rows = keyed.join(counts, ["mask", "value"], "left_anti") if hot else keyed
        dealt = plain_rows.repartition(width, "mask", "value").sortWithinPartitions("mask", "value", "fp")
        part = stage(dealt.mapInArrow(run, "src long, dst long").distinct(), f"simhash-links-{level}")
        found = part if found is None else found.unionByName(part)
        if not hot:
            return found
        rows = keyed.join(counts, ["mask", "value"], "left_semi").select("fp", "mask")
        fixed, level = [m % (1 << 64) for m in hot], level + 1


def groups(nodes: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """The different fingerprints of ``nodes`` (column fp, once each) with all their columns and the component ``_c``."""
    found = components.label(links(nodes, radius, limit)).withColumnRenamed("node", "fp")
    return nodes.join(found, "fp", "left").withColumn("_c", F.coalesce("least", "fp")).drop("least")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that links reach, itself included)."""
    rows = stage(fingerprints(docs, words), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    named = stage(groups(nodes, radius, limit), "fingerprint-components")
    least = named.groupBy("_c").agg(F.min("first").alias("component_id"))
    of_fp = stage(named.join(least, "_c").select("fp", "component_id"), "component-ids")
    return rows.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component: one row each.

    First is the smallest doc_id (null last), then the least hash of id and text; of rows equal in both one stays.
    """
    columns = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_held"), *row_key(docs))
    keys = row_key(docs)
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), keys[0], keys[1]).alias("key"), F.col("text").cast("string").alias("text"))
    rows = stage(with_fingerprint(rows, words), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("key").alias("first")), "fingerprint-nodes")
    kept = groups(nodes, radius, limit).groupBy("_c").agg(F.min("first").alias("first")).select("first._id", "first._row")
    # Rows that are equal in id and text meet by the key that the join has dealt them by.
    return held.join(stage(kept, "kept-documents"), ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"]).select("_held.*")
