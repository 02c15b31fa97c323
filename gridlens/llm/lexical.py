"""Ranked lexical search: the best documents for each query, by whole-number term weights and posting lists in geometric blocks.

A document is its vector of impacts, one per term that a query of the batch has. Documents are indexed in shards of about a thousand rows. Inside a shard, the posting
list of each term is clustered by the similarity of its documents (signed random projections against spread-out pivots of the list), and each cluster is a block with a
summary: for each coordinate the maximum over its documents, in units of ``UNIT``, rounded up. A summary has the coordinates that queries with its term can ask for. Weights
times maxima bound the score of every document in a block from above (Bruch et al., "Efficient Inverted Indexes for Approximate Retrieval over Learned Sparse
Representations", 2024; here nothing is approximate: no posting is left out and a block is skipped only if its bound is below the score to beat).

A query goes through the lists of its terms by falling contribution. It ends where the terms that are left can't reach the score to beat together; a document with only these
has no chance. The blocks of a list are read by falling bound, and their documents are scored in full. The score to beat is the k-th best of what the task has seen, and
at least the k-th best of the first wave, a sixteenth of the shards, which is searched before the others.

Scale: texts are read once per batch of queries (at most ``BATCH_TERMS`` terms or ``BATCH_ITEMS`` queries; these, and a document frequency for each term, are what the driver and
all tasks hold). Shards are cut from the scan as it comes, so nothing is shuffled but document frequencies, combined map-side, and at most k rows per query and task. A frequent
term's list is spread over all shards.

A term is a run of letters, digits or characters outside ASCII, A-Z lower-cased. Null and empty texts have no terms; a document without any isn't counted, and a query without
any finds nothing. Texts of any length are read whole, piece by piece. Each row of either table counts by itself, repeated or not. Equal scores go by ascending doc_id, null ids
first. Empty tables give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from gridlens.llm.common import NO_ID, discard, plain, stage

BATCH_TERMS, BATCH_ITEMS = 16_384, 2_000
#: Documents and postings of a shard, at most (a single document may have more postings).
SHARD_DOCUMENTS, SHARD_POSTINGS = 1_024, 300_000
#: Documents of a block, on average.
BLOCK = 32
UNIT = 16
#: Coordinates of the projections by which a list is clustered.
SKETCH = 32
#: One shard in so many is searched first.
WAVE = 16
#: Fixed values of the score: saturation of frequent terms, and the share of the document's length (in hundredths).
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 75

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
PIECE = 1 << 20
INDEX = "ids binary, at binary, terms binary, impacts binary, list_terms binary, list_blocks binary, starts binary, members binary, maxima binary, early boolean"
FOUND = "uid long, doc_id long, score long"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of some hundred thousand at most."""
    data, start = (text or "").encode().lower(), 0  # bytes.lower() changes A-Z only
    while start < len(data):
        gap = GAP.search(data, start + PIECE)
        end = gap.end() if gap else len(data)
        yield TERM.findall(data, start, end)
        start = end


@dataclass
class Batch:
    """Queries that are answered together: their terms as numbers, and for each query (uid, term numbers, repeats)."""

    vocabulary: dict[bytes, int]
    queries: list[tuple[int, list[int], list[int]]]

    def together(self) -> list[np.ndarray]:
        """For each term, itself and the terms of all queries that have it, in order."""
        of = [{t} for t in range(len(self.vocabulary))]
        for _, numbers, _ in self.queries:
            for t in numbers:
                of[t].update(numbers)
        return [np.array(sorted(x), np.int64) for x in of]


def batches(queries: DataFrame, text: str, keep: str) -> Iterator[tuple[Batch, list[tuple[int, object]]]]:
    """Batches of queries, with the (uid, id) of each; the driver holds one batch at a time."""
    batch, ids = Batch({}, []), []
    for uid, row in enumerate(queries.select(F.col(keep), F.col(text).cast("string")).toLocalIterator()):
        counts = Counter()
        for part in terms(row[1]):
            counts.update(part)
        if not counts:
            continue
        if batch.queries and (len(batch.queries) == BATCH_ITEMS or len(batch.vocabulary.keys() | counts.keys()) > BATCH_TERMS):
            yield batch, ids
            batch, ids = Batch({}, []), []
        numbers = [batch.vocabulary.setdefault(t, len(batch.vocabulary)) for t in counts]
        batch.queries.append((uid, numbers, list(counts.values())))
        ids.append((uid, row[0]))
    if batch.queries:
        yield batch, ids


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with terms: n counts all terms, terms and tfs are those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, numbers, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                n, found = 0, Counter()
                for part in terms(text.as_py()):
                    n += len(part)
                    found.update(map(vocabulary.get, part))
                found.pop(None, None)
                if n:
                    ids.append(doc_id.as_py())
                    lengths.append(n)
                    numbers.append(list(found))
                    counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"])

    return plain(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def impacts(tfs: np.ndarray, lengths: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What one occurrence in the query is worth, for each posting."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * n_docs) // all_terms
    return (SCALE * tfs) // (1000 * tfs + SATURATION * m)


def clustered(members: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A posting list in the order of its blocks, and where each begins."""
    if len(members) <= BLOCK:
        return members, np.zeros(1, np.int64)
    pivots = members[np.linspace(0, len(members) - 1, -(-len(members) // BLOCK)).astype(np.int64)]
    of = (sketches[members] @ sketches[pivots].T).argmax(1)
    order = of.argsort(kind="stable")
    return members[order], np.flatnonzero(np.diff(of[order], prepend=-1))


def shard_row(ids: np.ndarray, at: np.ndarray, numbers: np.ndarray, worth: np.ndarray, weights: np.ndarray, together: list[np.ndarray], signs: np.ndarray) -> list[bytes | bool]:
    """The index of one shard: the documents' vectors, and each term's blocks with their summaries."""
    doc = np.repeat(np.arange(len(ids)), np.diff(at))
    dense = np.zeros((len(ids), len(together)), np.uint16)
    dense[doc, numbers] = -(-worth // UNIT)
    sketches = (dense.astype(np.float32) * weights) @ signs
    sketches /= np.maximum(np.linalg.norm(sketches, axis=1, keepdims=True), 1e-9)
    order = numbers.argsort(kind="stable")
    present, first = np.unique(numbers[order], return_index=True)
    members, starts, blocks, maxima = [], [], [], []
    for t, a, b in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        own, begins = clustered(doc[order[a:b]], sketches)
        members.append(own)
        starts.append(begins + a)
        blocks.append(len(begins))
        maxima.append(np.maximum.reduceat(dense[np.ix_(own, together[t])], begins, axis=0).ravel())
    arrays = [
        ids.astype("<i8"), at.astype("<i4"), numbers.astype("<i4"), worth.astype("<i4"), present.astype("<i4"), np.array(blocks, "<i4"),
        np.concatenate(starts).astype("<i4"), np.concatenate(members).astype("<i4"), np.concatenate(maxima).astype("<u2")]
    return [*[a.tobytes() for a in arrays], zlib.crc32(arrays[0].tobytes()) % WAVE == 0]


def index(held: DataFrame, n_docs: int, all_terms: int, weights: np.ndarray, together: list[np.ndarray]) -> DataFrame:
    """A row per shard of the counted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (len(together), SKETCH))
        kinds = [pa.binary()] * 9 + [pa.bool_()]
        names = [c.split()[0] for c in INDEX.split(", ")]
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            lengths = batch.column(1).to_numpy(zero_copy_only=False)
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            numbers, tfs = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            at = np.concatenate([[0], np.cumsum(sizes)])
            worth, a = impacts(tfs, np.repeat(lengths, sizes), n_docs, all_terms), 0
            while a < len(ids):
                b = min(a + SHARD_DOCUMENTS, max(a + 1, int(np.searchsorted(at, at[a] + SHARD_POSTINGS, "right")) - 1))
                own = slice(at[a], at[b])
                row = shard_row(ids[a:b], at[a: b + 1] - at[a], numbers[own], worth[own], weights, together, signs)
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], names=names)
                a = b

    return held.filter(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(run, INDEX)


class Shard:
    """One shard, ready to be searched."""

    def __init__(self, row: dict, together: list[np.ndarray]):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, at, numbers = read("ids", "<i8"), read("at", "<i4"), read("terms", "<i4")
        self.dense = np.zeros((len(self.ids), len(together)), np.int32)
        self.dense[np.repeat(np.arange(len(self.ids)), np.diff(at)), numbers] = read("impacts", "<i4")
        starts, members, maxima = read("starts", "<i4"), read("members", "<i4"), read("maxima", "<u2")
        ends, self.lists, block, cell = np.append(starts[1:], len(members)), {}, 0, 0
        for t, n in zip(read("list_terms", "<i4").tolist(), read("list_blocks", "<i4").tolist()):
            width = len(together[t])
            summary = maxima[cell: cell + n * width].reshape(n, width)
            self.lists[t] = (starts[block: block + n], ends[block: block + n], summary, int(summary[:, np.searchsorted(together[t], t)].max()) * UNIT)
            block, cell = block + n, cell + n * width
        self.members, self.together = members, together

    def search(self, numbers: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], least: int, k: int) -> list[tuple[int, int]]:
        """``best`` ((-score, id), ascending) with the documents of this shard that belong there; scores below ``least`` don't matter."""

        def to_beat() -> int:
            return max(least, -best[-1][0] if len(best) == k else 1)

        reach = {t: w * self.lists[t][3] for t, w in zip(numbers.tolist(), weights.tolist()) if t in self.lists and w}
        order, left, seen = sorted(reach, key=lambda t: (-reach[t], t)), sum(reach.values()), None
        for t in order:
            if left < to_beat():
                break
            left -= reach[t]
            starts, ends, summary, _ = self.lists[t]
            bounds = summary[:, np.searchsorted(self.together[t], numbers)].astype(np.int64) @ weights * UNIT
            by_bound = bounds.argsort(kind="stable")[::-1]
            at, step = 0, 1
            while at < len(by_bound) and bounds[by_bound[at]] >= to_beat():
                some = [b for b in by_bound[at: at + step].tolist() if bounds[b] >= to_beat()]
                at, step = at + step, 2 * step
                rows = np.concatenate([self.members[starts[b]: ends[b]] for b in some])
                if seen is None:
                    seen = np.zeros(len(self.ids), bool)
                rows = rows[~seen[rows]]
                seen[rows] = True
                scores = self.dense[np.ix_(rows, numbers)].astype(np.int64) @ weights
                good = scores >= to_beat()
                if good.any():
                    best = sorted(best + list(zip((-scores[good]).tolist(), self.ids[rows[good]].tolist())))[:k]
        return best


def search(indexed: DataFrame, queries: list[tuple[int, list[int], list[int]]], together: list[np.ndarray], weights: np.ndarray, least: dict[int, int], k: int) -> DataFrame:
    """(uid, doc_id, score): what may be among the k best for each query, k rows a query and task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(uid, np.array(numbers), np.array(repeats) * weights[numbers]) for uid, numbers, repeats in queries]
        best: dict[int, list[tuple[int, int]]] = {uid: [] for uid, *_ in asked}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0], together)
                for uid, numbers, worth in asked:
                    best[uid] = shard.search(numbers, worth, best[uid], least.get(uid, 1), k)
        rows = [(uid, doc, -score) for uid, found in best.items() for score, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["uid", "doc_id", "score"])

    return indexed.mapInArrow(run, FOUND)


def top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, batch: Batch, k: int) -> DataFrame:
    """(uid, doc_id, score, rank) for one batch of queries."""
    held = stage(counted(docs, batch.vocabulary), "lexical-terms")
    sums = held.agg(F.count("*").alias("n_docs"), F.sum("n").alias("all_terms")).first()
    # A row per term of the batch.
    holding = {r.t: r.df for r in held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
    weights = np.array([math.floor(1000 * math.log((2 * sums.n_docs + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(batch.vocabulary))], np.int64)
    together = batch.together()
    shards = stage(index(held, sums.n_docs, sums.all_terms or 1, weights, together), "lexical-index", "early", maxRecordsPerFile=8)
    discard(held)
    first = stage(search(shards.filter("early"), batch.queries, together, weights, {}, k), "lexical-first")
    least = {r.uid: r.score for r in top(first, k).filter(F.col("rank") == k).collect()}
    rest = stage(search(shards.filter("not early"), batch.queries, together, weights, least, k), "lexical-rest")
    discard(shards)
    return top(first.unionByName(rest), k)


def rank(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", keep: str = "item_id") -> DataFrame:
    """``keep`` (a column of ``queries``), rank, doc_id and score of the k best documents with a score above 0 for each row of ``queries``."""
    spark, kind = docs.sparkSession, queries.schema[keep].dataType.simpleString()
    out = spark.createDataFrame([], f"`{keep}` {kind}, rank int, doc_id long, score long")
    for batch, ids in batches(queries, text, keep):
        names = spark.createDataFrame([Row(uid=u, name=n) for u, n in ids], f"uid long, name {kind}")
        found = ranked(docs, batch, k).join(F.broadcast(names), "uid")  # a batch of queries at most
        doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
        out = out.unionByName(stage(found.select(F.col("name").alias(keep), "rank", doc_id, "score"), "lexical-ranked"))
    return out
