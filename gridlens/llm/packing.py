"""Best-fit packing of token sequences by swap-based local search.

Every document becomes ids plus an end id. Documents over the sequence length are cut into full pieces behind one shorter first
piece, so full pieces fill a sequence alone and only the rest is packed. Pieces are dealt by hash into groups of bounded size. A
group starts from best fit (longest first, into the fullest sequence that still takes it); then a local search empties the least
filled sequences: a piece moves into the room of another sequence, takes the place of a shorter piece there, or two take the place of
one. Every step shifts tokens from a less to a more filled sequence, so the sum of squared fills only grows, and a sequence without
pieces is dropped. What is still underfull in all groups is packed again together, until one group holds it all or a round saves nothing.

Null texts are empty: a piece of one id. Repeated rows are separate pieces; an empty table gives no rows. The length of a text isn't
bounded: its pieces are made in one task that holds its ids once.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import plain, stage
from gridlens.llm.tokens import batches, encoder

#: Pieces of a group: what one task sorts and searches.
GROUP = 50_000
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("uid", pa.int64())])


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids: all full but the first."""
    first = n % size or min(n, size)
    edges = [0, *range(first, n + 1, size)]
    return list(zip(edges, edges[1:]))


def pieces(docs: DataFrame, vocabulary: str, size: int = 1024, end: int = 2) -> DataFrame:
    """The pieces of every text: place, length and checksum of its ids, and a number (uid) that no other piece has."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, uid = encoder(vocabulary, end), TaskContext.get().partitionId() << 40
        for frame in frames:
            names, texts = frame.column(0).to_pylist(), frame.column(1).to_pylist()
            for a, b in batches(texts):
                rows = []
                for name, ids in zip(names[a:b], encode.encode(texts[a:b])):
                    for k, (x, y) in enumerate(cuts(len(ids) // 4, size)):
                        rows.append((name, k, x, y - x, zlib.crc32(ids[4 * x:4 * y]), uid))
                        uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

    return plain(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, uid long")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Sequences as lists of indices: longest piece first, each into the least room that takes it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    rooms, open_bins, bins = [], {}, []  # rooms: sorted distinct rooms; open_bins: bins by room
    for i in order:
        x = lengths[i]
        k = bisect_left(rooms, x)
        if k == len(rooms):
            bins.append([i])
            b, room = len(bins) - 1, size
        else:
            room = rooms[k]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[k]
            bins[b].append(i)
        left = room - x
        if left:
            if left not in open_bins:
                insort(rooms, left)
                open_bins[left] = []
            open_bins[left].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], size: int, patience: int = 200) -> list[list[int]]:
    """Empty the least filled sequences by moves and swaps; stops when so many in a row can't be emptied or made fuller."""
    fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    where = np.full(len(lengths), -1, np.int64)
    for k, b in enumerate(bins):
        where[b] = k
    length = np.array(lengths, np.int64)
    failed = 0
    for donor in np.argsort(fill, kind="stable").tolist():
        if failed >= patience or int((size - fill).sum()) < size:
            break
        before = int(fill[donor])
        for _ in range(64):
            if not bins[donor] or not _step(donor, bins, fill, where, length, size):
                break
        failed = 0 if fill[donor] < before else failed + 1
    return [b for b in bins if b]


def _step(donor: int, bins: list[list[int]], fill: np.ndarray, where: np.ndarray, length: np.ndarray, size: int) -> bool:
    """One exchange that takes the most tokens out of ``donor`` into a fuller sequence."""
    room = size - fill
    room[(fill < fill[donor]) | (np.arange(len(fill)) == donor)] = 0
    if not room.any():
        return False
    own = bins[donor]
    best = (0, None, None, None)
    for x in own:  # move
        fits = np.flatnonzero(room >= length[x])
        if len(fits) and length[x] > best[0]:
            best = (int(length[x]), [x], int(fits[np.argmin(room[fits])]), None)
    others = np.flatnonzero(room[where] > 0)
    if len(others):
        spare = room[where[others]]
        pairs = [[x] for x in own] + [[x, y] for k, x in enumerate(own[:12]) for y in own[k + 1:12]]
        for pair in pairs:  # swap one or two for one
            gain = int(length[pair].sum()) - length[others]
            gain = np.where((gain > 0) & (gain <= spare), gain, 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (int(gain[k]), pair, int(where[others[k]]), int(others[k]))
    gain, moved, to, back = best
    if not gain:
        return False
    for x in moved:
        bins[donor].remove(x)
        bins[to].append(x)
        where[x] = to
    if back is not None:
        bins[to].remove(back)
        bins[donor].append(back)
        where[back] = donor
    fill[to] += gain
    fill[donor] -= gain
    return True


def _pack_group(size: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = frame.length.tolist()
        bins = local_search(best_fit(lengths, size), lengths, size)
        n = len(frame)
        sequence, offset, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k, members in enumerate(bins):
            at = 0
            for i in members:
                offset[i], sequence[i] = at, (int(key[0]) << 32) | k
                at += lengths[i]
            fill[members] = at
        return pd.DataFrame({"uid": frame.uid, "length": frame.length, "sequence_id": sequence, "offset": offset, "fill": fill})

    return run


def assign(parts: DataFrame, size: int = 1024, group: int = GROUP, settled: float = 0.995) -> DataFrame:
    """(uid, sequence_id, offset) of every piece. Sequences filled to ``settled`` stay; the others meet again in fewer groups."""
    spark = parts.sparkSession
    full = parts.filter(F.col("length") == size).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, round_, last = parts.filter(F.col("length") < size).select("uid", "length"), [full], 0, None
    n = rest.count()
    while n:
        groups = -(-n // group)
        dealt = rest.withColumn("_g", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(groups)) + F.lit(round_ << 24))
        packed = stage(dealt.groupBy("_g").applyInPandas(_pack_group(size), "uid long, length long, sequence_id long, offset long, fill long"), "packed")
        loose = F.col("fill") < settled * size
        again = packed.filter(loose)
        left = again.count()
        if groups == 1 or left == 0 or left == last or left > 0.9 * n:
            done.append(packed.select("uid", "sequence_id", "offset"))
            break
        done.append(packed.filter(~loose).select("uid", "sequence_id", "offset"))
        rest, n, last, round_ = again.select("uid", "length"), left, left, round_ + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end: int = 2, group: int = GROUP) -> DataFrame:
    """Pieces with their sequence and offset, and the uid of the piece."""
    parts = stage(pieces(docs, vocabulary, size, end), "pieces")
    return parts.join(assign(parts, size, group), "uid")
