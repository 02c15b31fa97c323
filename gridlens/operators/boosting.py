"""Gradient boosting on any number of classes: histogram trees with softmax gradients, one tree a round for all classes.

Rows are binned once by the exact quantiles of their columns and kept in blocks of some thousand rows. A job per tree level
adds up gradients by (node, feature, bin) in each partition; the sums are merged per feature in a tree of tasks, which also
find the best cut of each node, so the driver only sees one candidate per node and feature. Class scores of the rows are
written anew every few rounds; in between, a task applies the trees grown since then. Nothing is kept in executors.

A leaf holds a value per class. Gradients are whole numbers of 2**-24, so that sums don't depend on the order of rows, and
row draws are a function of a row's id (without one: of its values, so that equal rows are drawn together) and the seed:
the same rows give the same model, however they are partitioned and whatever is run again. Missing values lie below every
cut. Rows without a label or with an empty vector are left out; a table without rows is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsReadable, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators import ensemble
from gridlens.operators.quantiles import column_quantiles
from gridlens.session import cut_lineage, spread

#: Rows of a block, and gradients of one unit.
BLOCK = 4096
UNIT = float(1 << 24)
#: Bytes of one partition's sums; levels with more nodes are done in several passes.
SUMS = 64 << 20
#: Partial sums that one merging task takes per feature.
FAN_IN = 64
#: Rounds after which the rows' scores are written.
SETTLE = 10


class Tree:
    """Nodes as arrays: feature (-1: leaf), last bin that goes left, left child (the right one follows), value per class."""

    def __init__(self, feature, cut, left, value):
        self.feature, self.cut = np.asarray(feature, np.int32), np.asarray(cut, np.int32)
        self.left, self.value = np.asarray(left, np.int32), np.asarray(value, np.float64)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        node, row = np.zeros(len(bins), np.int32), np.arange(len(bins))
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            right = bins[row, np.maximum(feature, 0)] > self.cut[node]
            node = np.where(inner, self.left[node] + right, node)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: 0 where the value is missing, else 1 plus the number of cuts below it."""
    out = np.zeros(x.shape, np.uint8)
    for j, edges in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(edges, x[:, j], side="left"))
    return out


def matrix(vectors: pa.Array | pd.Series, width: int) -> np.ndarray:
    """Rows of numbers; a null element is missing, shorter vectors end in missing values, longer ones are cut to the width."""
    if isinstance(vectors, pd.Series):
        vectors = pa.array(vectors, pa.list_(pa.float64()))
    out = np.full((len(vectors), width), np.nan)
    lengths = np.minimum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), width)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])[:-1]
    keep = np.arange(width)[None, :] < lengths[:, None]
    out[keep] = flat[(starts[:, None] + np.arange(width)[None, :])[keep]]
    return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def drawn(keys: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Whether each row is drawn: its key, mixed with the seed, lies in the share."""
    if share >= 1:
        return np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        z = keys.view(np.uint64) + np.uint64(seed % (1 << 63)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share


# ---- blocks of rows ------------------------------------------------------------------------

BLOCKS = "n int, y binary, w binary, k binary, bins binary, scores binary"


def _to_blocks(cuts: list[np.ndarray], base: np.ndarray):
    """Arrow batches (label, weight, key, features) to blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                bins = binned(matrix(part.column("x"), len(cuts)), cuts)
                numbers = [part.column("y").to_numpy().astype(np.int32), part.column("w").to_numpy(), part.column("k").to_numpy()]
                scores = np.tile(base, (part.num_rows, 1))
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([part.num_rows], pa.int32()), **{c: pa.array([v.tobytes()]) for c, v in zip("ywk", numbers)},
                    "bins": pa.array([bins.tobytes()]), "scores": pa.array([scores.tobytes()])})

    return run


def _blocks(batches: Iterator[pa.RecordBatch], width: int, classes: int, trees: list[Tree]):
    """(n, y, w, k, bins, scores) of each block, the scores with ``trees`` applied."""
    for batch in batches:
        for r in batch.to_pylist():
            bins = np.frombuffer(r["bins"], np.uint8).reshape(r["n"], width)
            scores = np.frombuffer(r["scores"], np.float64).reshape(r["n"], classes)
            for tree in trees:
                scores = scores + tree.value[tree.leaves(bins)]
            yield r, np.frombuffer(r["y"], np.int32), np.frombuffer(r["w"], np.float64), np.frombuffer(r["k"], np.int64), bins, scores


def _settle(width: int, classes: int, trees: list[Tree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, *_, scores in _blocks(batches, width, classes, trees):
            r["scores"] = scores.tobytes()
            yield pa.RecordBatch.from_pydict({c: pa.array([r[c]], pa.int32() if c == "n" else pa.binary()) for c in r})

    return run


# ---- sums of gradients and cuts --------------------------------------------------------------

PARTIAL = "feature int, branch int, sums binary"


def _gradients(y: np.ndarray, w: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """First and second derivatives of the log loss per class, side by side, in whole units."""
    p = softmax(scores)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    return np.rint(np.hstack([g, np.maximum(p * (1 - p), 1e-6)]) * w[:, None] * UNIT)


def _partial_sums(width, classes, bins_of, trees, tree, nodes, features, seed, share):
    """Per partition: the sums of its rows at ``nodes`` of the growing tree, one record per feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k2 = 2 * classes
        sums = np.zeros((len(features), len(nodes) * bins_of * k2))
        slot = np.full(len(tree.feature), -1, np.int64)
        slot[nodes] = np.arange(len(nodes))
        lane, seen = np.arange(k2), False
        for _, y, w, k, bins, scores in _blocks(batches, width, classes, trees):
            at = slot[tree.leaves(bins)]
            use = (at >= 0) & drawn(k, seed, share)
            if not use.any():
                continue
            seen, at, bins = True, at[use] * bins_of, bins[use]
            gh = _gradients(y[use], w[use], scores[use]).ravel()
            for i, f in enumerate(features):
                cell = ((at + bins[:, f])[:, None] * k2 + lane).ravel()
                sums[i] += np.bincount(cell, gh, sums.shape[1])
        if seen:
            branch = TaskContext.get().partitionId()
            for i, f in enumerate(features):
                yield pa.RecordBatch.from_pydict({
                    "feature": pa.array([f], pa.int32()), "branch": pa.array([branch], pa.int32()), "sums": pa.array([sums[i].astype(np.int64).tobytes()])})

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(feature, branch, added sums) of sorted partial sums; one total is held at a time."""
    key, total = None, None
    for batch in batches:
        for feature, branch, sums in zip(*(batch.column(c) for c in ("feature", "branch", "sums"))):
            sums = np.frombuffer(sums.as_buffer(), np.int64)
            if key == (feature.as_py(), branch.as_py()):
                total += sums
                continue
            if key is not None:
                yield *key, total
            key, total = (feature.as_py(), branch.as_py()), sums.copy()
    if key is not None:
        yield *key, total


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for feature, branch, total in _runs(batches):
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array([feature], pa.int32()), "branch": pa.array([branch], pa.int32()), "sums": pa.array([total.tobytes()])})


def _sorted(sums: DataFrame, fan_in: int | None) -> DataFrame:
    """Partial sums of a feature (of one branch in ``fan_in`` numbers) behind each other in one task."""
    branch = F.floor(F.col("branch") / fan_in).cast("int") if fan_in else F.lit(0)
    keyed = sums.select("feature", branch.alias("branch"), "sums")
    return keyed.repartition(*(["feature", "branch"] if fan_in else ["feature"])).sortWithinPartitions("feature", "branch")


CANDIDATES = "slot int, feature int, cut int, gain double, lower binary, total binary"


def _best_cuts(nodes: int, bins_of: int, classes: int, penalty: float, least: float):
    """Of all partial sums of a feature: the cut of each node that gains most (the lowest one on a tie)."""
    value = lambda s: (s[..., :classes] ** 2 / (s[..., classes:] + penalty)).sum(-1)

    def best(feature: int, sums: np.ndarray) -> pa.RecordBatch:
        below = np.cumsum(sums, axis=1)
        total = below[:, -1]
        low = below[:, :-1] / UNIT
        high = (total[:, None] - below[:, :-1]) / UNIT
        gain = value(low) + value(high) - value(total / UNIT)[:, None]
        fits = (low[..., classes:].sum(-1) >= least) & (high[..., classes:].sum(-1) >= least)
        gain = np.where(fits, gain, -1.0)
        cut = gain.argmax(axis=1)
        row = np.arange(nodes)
        return pa.RecordBatch.from_pydict({
            "slot": pa.array(row, pa.int32()), "feature": pa.array([feature] * nodes, pa.int32()), "cut": pa.array(cut, pa.int32()),
            "gain": pa.array(gain[row, cut]), "lower": pa.array([below[i, c].tobytes() for i, c in enumerate(cut)]),
            "total": pa.array([t.tobytes() for t in total])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for feature, _, sums in _runs(batches):
            yield best(feature, sums.reshape(nodes, bins_of, 2 * classes))

    return run


# ---- estimator and model ---------------------------------------------------------------------

class _BoostingParams(Params):
    """Names follow the ML library where it has the same parameter."""

    maxIter = Param(Params._dummy(), "maxIter", "rounds, one tree each", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of cuts of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a leaf's step that is taken", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows a tree learns from", TypeConverters.toFloat)
    columnRate = Param(Params._dummy(), "columnRate", "share of columns a tree may cut", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a column, without that of missing values; at most 254", TypeConverters.toInt)
    regParam = Param(Params._dummy(), "regParam", "added to the second derivatives of a leaf", TypeConverters.toFloat)
    minWeight = Param(Params._dummy(), "minWeight", "least sum of second derivatives on a side of a cut", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of draws", TypeConverters.toInt)
    weightCol = Param(Params._dummy(), "weightCol", "column of row weights; empty: all 1", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "column of row ids for draws; empty: a hash of the row's values", TypeConverters.toString)

    def _defaults(self):
        self._setDefault(maxIter=300, maxDepth=6, stepSize=0.05, subsamplingRate=0.85, columnRate=0.85, maxBins=32, regParam=1.0,
                         minWeight=1.0, seed=42, weightCol="", idCol="")

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))


class BoostedTrees(Estimator, _BoostingParams, DefaultParamsWritable, DefaultParamsReadable):
    """Learns from ``label`` (class numbers from 0) and ``features`` (vectors); all classes in one fit."""

    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        rows, classes, width, base = self._rows(spread(df, BLOCK))
        cuts = self._cuts(rows, width)
        bins_of = max(len(c) for c in cuts) + 2
        blocks = cut_lineage(rows.mapInArrow(_to_blocks(cuts, base), BLOCKS))
        trees, settled, gains, parts = [], 0, np.zeros(width), blocks.rdd.getNumPartitions()
        for r in range(self.value("maxIter")):
            if len(trees) - settled >= SETTLE:
                blocks = cut_lineage(blocks.mapInArrow(_settle(width, classes, trees[settled:]), BLOCKS))
                settled = len(trees)
            tree = self._grow(blocks, trees[settled:], r, width, classes, bins_of, gains, parts)
            if len(tree.feature) == 1:
                break
            trees.append(tree)
        model = BoostedTreesModel(trees, cuts, base, gains)
        return self._copyValues(model)

    def _rows(self, df: DataFrame):
        """(rows of label, weight, key and array; number of classes; width; log of class shares)."""
        w, i = self.value("weightCol"), self.value("idCol")
        x = vector_to_array("features")
        named = df.where("label is not null").select(
            F.col("label").cast("int").alias("y"), (F.col(w).cast("double") if w else F.lit(1.0)).alias("w"),
            (F.xxhash64(F.col(i)) if i else F.xxhash64("label", x)).alias("k"), x.alias("x"),
        ).where("size(x) > 0 and w > 0")
        counted = named.groupBy("y").agg(F.sum("w").alias("w"), F.max(F.size("x")).alias("width")).collect()
        if not counted:
            raise ValueError("no rows with a label, a vector and a positive weight")
        if min(c["y"] for c in counted) < 0:
            raise ValueError("labels are class numbers from 0")
        share = np.zeros(max(2, 1 + max(c["y"] for c in counted)))
        for c in counted:
            share[c["y"]] = c["w"]
        return named, len(share), max(c["width"] for c in counted), np.log(np.maximum(share / share.sum(), 1e-6))

    def _cuts(self, rows: DataFrame, width: int) -> list[np.ndarray]:
        """Different exact quantiles of each column."""
        bins = min(254, self.value("maxBins"))
        number = lambda j: F.get("x", F.lit(j))
        columns = rows.select(*[F.when(~F.isnan(number(j)), number(j)).alias(f"x{j}") for j in range(width)])
        found = column_quantiles(columns, columns.columns, [i / bins for i in range(1, bins)])
        return [np.array(sorted({v for v in found[c] if v is not None})) for c in columns.columns]

    def _grow(self, blocks, trees, r, width, classes, bins_of, gains, parts) -> Tree:
        """One tree: a job per level, or several where a level's sums would be too large."""
        seed, rate, penalty = self.value("seed"), self.value("stepSize"), self.value("regParam")
        pick = np.random.default_rng([seed % (1 << 32), r])
        features = sorted(pick.choice(width, max(1, math.ceil(self.value("columnRate") * width)), replace=False).tolist())
        step = lambda s: -rate * (s[:classes] / UNIT) / (s[classes:] / UNIT + penalty)
        feature, cut, left, value, open_nodes = [-1], [0], [0], [np.zeros(classes)], [0]
        at_once = max(1, SUMS // (len(features) * bins_of * 2 * classes * 8))
        for _ in range(self.value("maxDepth")):
            found = {}
            for first in range(0, len(open_nodes), at_once):
                nodes = open_nodes[first:first + at_once]
                sums = blocks.mapInArrow(_partial_sums(
                    width, classes, bins_of, trees, Tree(feature, cut, left, value), nodes, features, seed * 1_000_003 + r, self.value("subsamplingRate"),
                ), PARTIAL)
                left_over = parts
                while left_over > FAN_IN:
                    sums = _sorted(sums, FAN_IN).mapInArrow(_merge, PARTIAL)
                    left_over = math.ceil(left_over / FAN_IN)
                best = _sorted(sums, None).mapInArrow(_best_cuts(len(nodes), bins_of, classes, penalty, self.value("minWeight")), CANDIDATES)
                for c in best.where("gain > 1e-9").collect():
                    node, rank = nodes[c["slot"]], (-c["gain"], c["feature"])
                    if node not in found or rank < found[node][0]:
                        found[node] = (rank, c)
            open_nodes = []
            for node in sorted(found):
                c = found[node][1]
                lower, total = np.frombuffer(c["lower"], np.int64), np.frombuffer(c["total"], np.int64)
                feature[node], cut[node], left[node] = c["feature"], c["cut"], len(feature)
                gains[c["feature"]] += c["gain"]
                for side in (lower, total - lower):
                    open_nodes.append(len(feature))
                    feature.append(-1), cut.append(0), left.append(0), value.append(step(side))
            if not open_nodes:
                break
        return Tree(feature, cut, left, value)


class BoostedTreesModel(Model, _BoostingParams, MLWritable, MLReadable):
    """Trees on bins, the cuts that make the bins, the starting score of each class, and the gain of each feature."""

    def __init__(self, trees: list[Tree], cuts: list[np.ndarray], base: np.ndarray, gains: np.ndarray):
        super().__init__()
        self._defaults()
        self.trees, self.cuts, self.base, self.gains = trees, cuts, np.asarray(base), np.asarray(gains)

    @property
    def numClasses(self) -> int:
        return len(self.base)

    @property
    def featureImportances(self) -> DenseVector:
        total = self.gains.sum()
        return DenseVector(self.gains / total if total > 0 else self.gains)

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, cuts, base = self.trees, self.cuts, self.base

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            bins = binned(matrix(x, len(cuts)), cuts)
            scores = np.tile(base, (len(bins), 1))
            for tree in trees:
                scores += tree.value[tree.leaves(bins)]
            return pd.Series(list(softmax(scores)))

        keep = [F.col(f"`{c}`") for c in df.columns if c not in ("prediction", "probability")]
        scored = df.select(*keep, score(vector_to_array("features")).alias("probability"))
        return scored.select(*keep, array_to_vector("probability").alias("probability"), ensemble.top_class("probability").alias("prediction"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    """Metadata, and tables of the nodes and of the columns' cuts."""

    def __init__(self, model: BoostedTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"base": m.base.tolist(), "trees": len(m.trees)})
        nodes = [(r, i, int(t.feature[i]), int(t.cut[i]), int(t.left[i]), t.value[i].tolist()) for r, t in enumerate(m.trees) for i in range(len(t.feature))]
        spark.createDataFrame(nodes, "tree int, node int, feature int, cut int, left int, value array<double>").coalesce(1).write.parquet(f"{path}/nodes")
        columns = [(j, c.tolist(), float(m.gains[j])) for j, c in enumerate(m.cuts)]
        spark.createDataFrame(columns, "feature int, cuts array<double>, gain double").coalesce(1).write.parquet(f"{path}/columns")


class _Reader(MLReader):
    def load(self, path: str) -> BoostedTreesModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        by_tree: list[list] = [[] for _ in range(metadata["trees"])]
        for row in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            by_tree[row["tree"]].append(row[2:])
        columns = spark.read.parquet(f"{path}/columns").orderBy("feature").collect()
        model = BoostedTreesModel([Tree(*zip(*nodes)) for nodes in by_tree], [np.array(c["cuts"]) for c in columns],
                                  np.array(metadata["base"]), np.array([c["gain"] for c in columns]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
