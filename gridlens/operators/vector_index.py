"""Nearest neighbours in many dimensions by inverted lists with residual codes, re-ranked exactly.

After Jegou et al., "Product Quantization for Nearest Neighbor Search" (2011). Every row goes to the list of its nearest coarse
centre and is kept there as one byte per group of elements: the codeword nearest to what the centre leaves. A query visits the
``probes`` lists with the nearest centres, its best ``depth`` candidates by code distance are joined with their whole vectors, and
the answer has exact distances.

Centres and codewords are fitted on a bounded sample (``SAMPLE`` rows by hash, ``SAMPLE_VALUES`` numbers at most); all rows are indexed. ``probes`` and ``depth`` are
read off a second bounded sample (``TUNING`` rows): its true neighbours are found by comparing it with all rows, and the least
values under which the wanted share of them is found are stored. ``recall`` measures the share anew on other rows.

Lists are cut into blocks of about ``BLOCK`` rows, one row of the block table each, and the visitors of a busy block are dealt out
to several tasks, so neither a hot list nor many queries at one place meet in one task. Ids are unique. Rows whose vector is null,
holds a null, NaN or infinity, or is shorter than the longest one are not indexed; as queries they find nothing. Copies are
rows of their own, and ties go to the smaller id. Columns other than the id and the vector are ignored. An empty table is an index without rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.functions.hashing import hash31
from gridlens.session import cut_lineage, lookup

SAMPLE, SAMPLE_VALUES = 65_536, 1 << 22
TUNING = 256
BLOCK = 8_192
MOST_LISTS = 4_096
#: Queries whose distances are computed at a time, and visitors of a block in one task.
SLICE, VISITORS = 256, 8_192


def whole_vectors(df: DataFrame, row_id: str, features: str, width: int | None = None) -> DataFrame:
    """(id, x) of the rows whose vector has ``width`` (by default the largest number of) elements, all finite."""
    rows = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(features).cast("array<double>").alias("x"))
    if width is None:
        width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return rows.where((F.size("x") == int(width)) & (F.size("x") > 0) & ~F.exists("x", odd))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs by one matrix product; small errors are mended by the exact re-ranking."""
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i:i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)])


def _centres(x: np.ndarray, n: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Means of ``n`` groups of a bounded sample; an empty group keeps its place."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        size, total = np.bincount(near, minlength=len(centres)), np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Codec:
    """Coarse centres and, per group of elements, the codewords of what they leave."""

    centres: np.ndarray
    books: tuple[np.ndarray, ...]

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def groups(self) -> list[slice]:
        ends = np.cumsum([b.shape[1] for b in self.books])
        return [slice(int(e) - b.shape[1], int(e)) for e, b in zip(ends, self.books)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = _nearest(x, self.centres)
        left = x - self.centres[near]
        return near, np.stack([_nearest(left[:, g], b) for g, b in zip(self.groups(), self.books)], axis=1).astype(np.uint8)

    def decode(self, where, codes: np.ndarray) -> np.ndarray:
        return self.centres[where] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)

    @staticmethod
    def fit(sample: np.ndarray, lists: int, groups: int, seed: int) -> Codec:
        different = np.unique(sample, axis=0)  # copies would give several equal centres
        centres = _centres(different, lists, seed)
        centres = centres[np.unique(_nearest(different, centres))]  # no list without rows
        left = sample - centres[_nearest(sample, centres)]
        return Codec(centres, tuple(_centres(part, 256, seed + 1) for part in np.array_split(left, groups, axis=1)))


@dataclass(frozen=True)
class VectorIndex:
    """An index below ``path``: tables ``vectors`` (id, x), ``blocks`` (list, block, ids, codes), and the fitted numbers."""

    path: str
    codec: Codec | None
    probes: int
    depth: int

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/blocks")


def build(df: DataFrame, row_id: str, features: str, path: str, lists: int | None = None, groups: int | None = None,
          k: int = 10, share: float = 0.95, seed: int = 42) -> VectorIndex:
    """Index all rows below ``path``. Defaults: lists by the root of the row count, a byte per four elements."""
    spark = df.sparkSession
    whole_vectors(df, row_id, features).write.mode("overwrite").parquet(f"{path}/vectors")
    vectors = spark.read.parquet(f"{path}/vectors")
    total = vectors.count()
    if total == 0:
        return _save(spark, VectorIndex(path, None, 0, 0))
    width = vectors.select(F.size("x")).first()[0]
    sample = _sample(vectors, min(SAMPLE, max(1, SAMPLE_VALUES // width)), seed)
    sample = np.stack(sample["x"].to_numpy())
    lists = min(lists or max(1, round(math.sqrt(total))), MOST_LISTS, len(sample))
    codec = Codec.fit(sample, lists, groups or max(1, sample.shape[1] // 4), seed)
    held = spark.sparkContext.broadcast(codec)  # at most 4,096 centres and 256 codewords per group

    def encode(batches):
        for b in batches:
            if len(b):
                near, codes = held.value.encode(np.stack(b["x"].to_numpy()))
                yield pd.DataFrame({"id": b["id"], "list": near.astype("int32"), "code": [c.tobytes() for c in codes]})

    coded = cut_lineage(vectors.mapInPandas(encode, "id bigint, list int, code binary"))
    cuts = coded.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts"))
    parted = coded.join(F.broadcast(cuts), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))  # a row per list

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        return pd.DataFrame({"list": [group["list"].iloc[0]], "block": [group["block"].iloc[0]],
                             "ids": [group["id"].to_numpy()], "codes": [b"".join(group["code"])]})

    parted.groupBy("list", "block").applyInPandas(pack, "list int, block int, ids array<bigint>, codes binary").write.mode(
        "overwrite").parquet(f"{path}/blocks")
    index = VectorIndex(path, codec, len(codec.centres), total)
    return _save(spark, VectorIndex(path, codec, *_tuned(spark, index, k, share, seed + 1)))


def _sample(vectors: DataFrame, rows: int, seed: int) -> pd.DataFrame:
    return vectors.orderBy(hash31("id", seed), "id").limit(rows).toPandas()


def _save(spark: SparkSession, index: VectorIndex) -> VectorIndex:
    numbers = {"probes": index.probes, "depth": index.depth, "centres": None, "books": []}
    if index.codec:
        numbers |= {"centres": index.codec.centres.tolist(), "books": [b.tolist() for b in index.codec.books]}
    spark.createDataFrame([(json.dumps(numbers),)], "numbers string").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/fitted")
    return index


def load(spark: SparkSession, path: str) -> VectorIndex:
    numbers = json.loads(spark.read.parquet(f"{path}/fitted").first()[0])
    codec = Codec(np.array(numbers["centres"]), tuple(map(np.array, numbers["books"]))) if numbers["books"] else None
    return VectorIndex(path, codec, numbers["probes"], numbers["depth"])


def compared(vectors: DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query, id, square): the true ``k`` nearest other rows of a bounded set of queries (id, x), by comparison with all rows."""
    spark = vectors.sparkSession
    held = spark.sparkContext.broadcast((asked["id"].to_numpy(), np.stack(asked["x"].to_numpy())))

    def best(batches):
        ids, q = held.value
        for b in batches:
            if len(b):
                own, x = b["id"].to_numpy(), np.stack(b["x"].to_numpy())
                d = np.maximum(_squares(q, x), 0)
                d[ids[:, None] == own[None]] = np.inf
                at = np.argpartition(d, min(k, len(x)) - 1, axis=1)[:, :k]
                yield pd.DataFrame({"query": np.repeat(ids, at.shape[1]), "id": own[at].ravel(), "square": np.take_along_axis(d, at, 1).ravel()})

    found = vectors.mapInPandas(best, "query bigint, id bigint, square double").where("square < double('inf')")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("square", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "id", "square").toPandas()  # k rows a query


def _tuned(spark: SparkSession, index: VectorIndex, k: int, share: float, seed: int) -> tuple[int, int]:
    """Least lists to visit, and candidates to re-rank, for ``share`` of the true neighbours of some sampled rows."""
    vectors, codec = index.vectors(spark), index.codec
    asked = _sample(vectors, TUNING, seed)
    true = compared(vectors, asked, k)
    if not len(true):
        return 1, k
    ids, q = asked["id"].to_numpy(), np.stack(asked["x"].to_numpy())
    place = pd.Series(np.arange(len(ids)), index=ids)
    wanted = vectors.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"id": true["id"].unique()}))), "id").toPandas()  # bounded
    near, codes = codec.encode(np.stack(wanted["x"].to_numpy()))
    row = pd.Series(np.arange(len(wanted)), index=wanted["id"])[true["id"]].to_numpy()
    query = place[true["query"]].to_numpy()
    order = np.argsort(np.argsort(_squares(q, codec.centres), axis=1, kind="stable"), axis=1)
    at = order[query, near[row]]
    # Each of the two cuts may lose half of what may be missed.
    half = 1 - (1 - share) / 2
    probes = int(np.quantile(at, half, method="higher")) + 1
    limits = ((q[query] - codec.decode(near, codes)[row]) ** 2).sum(axis=1)
    limits = limits * (1 - 1e-9) - 1e-9  # rows with the same code, such as copies, aren't ahead of each other
    held = spark.sparkContext.broadcast((codec, q, query, limits, order < probes))

    def ahead(batches):
        codec, q, query, limits, visited = held.value
        total = np.zeros(len(limits), dtype=np.int64)
        for b in batches:
            for where, blob in zip(b["list"], b["codes"]):
                x = codec.decode(where, np.frombuffer(blob, np.uint8).reshape(-1, len(codec.books)))
                for i in range(0, len(q), SLICE):
                    mine = (query >= i) & (query < i + SLICE) & visited[query, where]
                    if mine.any():
                        d = np.sort(_squares(q[i:i + SLICE], x), axis=1)
                        total[mine] += [np.searchsorted(d[a - i], t) for a, t in zip(query[mine], limits[mine])]
        yield pd.DataFrame({"at": np.arange(len(total)), "n": total})

    counts = index.blocks(spark).mapInPandas(ahead, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    return probes, max(k, int(np.quantile(counts["n"], half, method="higher")) + 2)


def search(index: VectorIndex, queries: DataFrame, row_id: str, features: str, k: int = 10, others: bool = True,
           probes: int | None = None, depth: int | None = None) -> DataFrame:
    """(id, neighbor, distance, rank): up to ``k`` near rows of each query by exact distance and id.

    ``others`` leaves out the indexed row with the query's own id. With ``probes`` the number of lists and ``depth`` the
    number of rows the answer is exact.
    """
    spark, codec = queries.sparkSession, index.codec
    if codec is None:
        return spark.createDataFrame([], "id bigint, neighbor bigint, distance double, rank bigint")
    probes, depth = min(probes or index.probes, len(codec.centres)), (depth or index.depth) + int(others)
    held = spark.sparkContext.broadcast(codec)
    asked = cut_lineage(whole_vectors(queries, row_id, features, codec.width))

    def visits(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy())
                lists = np.argpartition(_squares(x, held.value.centres), probes - 1, axis=1)[:, :probes]
                packed = np.array([v.tobytes() for v in x.astype("<f4")], dtype=object)
                yield pd.DataFrame({"query": np.repeat(b["id"].to_numpy(), probes), "list": lists.ravel().astype("int32"), "q": np.repeat(packed, probes)})

    visiting = cut_lineage(asked.mapInPandas(visits, "query bigint, list int, q binary"))
    blocks = index.blocks(spark)
    # A row per list: its blocks, and the lanes over which its visitors are dealt out.
    load = visiting.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("lanes"))
    cuts = cut_lineage(blocks.groupBy("list").agg(F.count(F.lit(1)).cast("int").alias("cuts")).join(load, "list"))
    to = visiting.join(F.broadcast(cuts), "list").select(
        "query", "q", "list", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("block"),
        F.pmod(F.xxhash64("query"), F.col("lanes")).cast("int").alias("lane"))
    lists = blocks.join(F.broadcast(cuts), "list").select(
        F.col("list").alias("in_list"), F.col("block").alias("in_block"), "ids", "codes",
        F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("in_lane"))

    def meet(visitors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for where, ids, blob in zip(block["in_list"], block["ids"], block["codes"]):
            codec, ids = held.value, np.asarray(ids)
            x = codec.decode(where, np.frombuffer(blob, np.uint8).reshape(len(ids), -1))
            for first in range(0, len(visitors), SLICE):
                some = visitors.iloc[first:first + SLICE]
                d = _squares(np.stack([np.frombuffer(v, "<f4") for v in some["q"]]).astype(float), x)
                at = np.argpartition(d, min(depth, len(ids)) - 1, axis=1)[:, :depth]
                parts.append(pd.DataFrame({"query": np.repeat(some["query"].to_numpy(), at.shape[1]), "id": ids[at].ravel(),
                                           "close": np.take_along_axis(d, at, 1).ravel()}))
        return pd.concat(parts) if parts else pd.DataFrame({"query": [], "id": [], "close": []})

    met = to.groupBy("list", "block", "lane").cogroup(lists.groupBy("in_list", "in_block", "in_lane")).applyInPandas(
        meet, "query bigint, id bigint, close double")
    first = F.row_number().over(Window.partitionBy("query").orderBy("close", "id"))
    few = lookup(met.withColumn("at", first).where(F.col("at") <= depth).select("query", "id"))
    exact = F.sqrt(F.aggregate(F.zip_with("x", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    pairs = index.vectors(spark).join(few, "id").join(asked.select(F.col("id").alias("query"), F.col("x").alias("q")), "query")
    if others:
        pairs = pairs.where("id <> query")
    best = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor"))
    return pairs.select(F.col("query").alias("id"), F.col("id").alias("neighbor"), exact.alias("distance")).withColumn(
        "rank", best.cast("bigint")).where(F.col("rank") <= k)


def recall(spark: SparkSession, index: VectorIndex, k: int = 10, rows: int = TUNING, seed: int = 7) -> float:
    """Share of the true ``k`` nearest that the index finds for ``rows`` sampled rows; null distances or no rows give 1."""
    vectors = index.vectors(spark)
    asked = _sample(vectors, rows, seed)
    true = compared(vectors, asked, k) if len(asked) else asked
    if not len(true):
        return 1.0
    sample = vectors.join(F.broadcast(spark.createDataFrame(asked[["id"]])), "id")
    found = search(index, sample, "id", "x", k).select("id", "distance").toPandas()  # k rows a query
    # A row as near as the farthest true neighbour is as good: ties have no order in a comparison by distance.
    far = np.sqrt(true.groupby("query")["square"].max())
    within = found["distance"].to_numpy() <= far[found["id"]].to_numpy() * (1 + 1e-6) + 1e-6
    return float(within.sum() / len(true))
