"""Unsupervised anomaly detection. Models are small and bounded; scoring is spread over the rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.aggregates import correlation
from gridlens.functions.hashing import M31, hash31
from gridlens.functions.scalar import col
from gridlens.operators import ordered
from gridlens.operators.profile import row_stats
from gridlens.operators.quantiles import agg_row, column_quantiles
from gridlens.session import cut_lineage


def flag_share(df: DataFrame, score: str, contamination: float, name: str = "anomaly", high: bool = True) -> DataFrame:
    """Flag the most extreme share of rows by the exact quantile of their score.

    Scores are written once, so the threshold search and the flag read them back; pass narrow rows.
    """
    df = cut_lineage(df)
    cut = column_quantiles(df, [score], [1 - contamination if high else contamination])[score][0]
    hit = F.col(score) > F.lit(cut) if high else F.col(score) < F.lit(cut)
    return df.withColumn(name, F.coalesce(hit, F.lit(False)))


# ---- isolation forest ----------------------------------------------------------------

def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


_TREE = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, path array<double>"


def _grow(tree: int, x: np.ndarray, seed: int) -> dict:
    """One isolation tree over at most a few hundred rows, as node arrays."""
    draw = np.random.default_rng([seed, tree])
    limit = max(1, math.ceil(math.log2(max(len(x), 2))))
    nodes = {"feature": [], "cut": [], "left": [], "right": [], "path": []}
    waiting = [(np.arange(len(x)), 0, None)]
    while waiting:
        rows, depth, parent = waiting.pop()
        here = len(nodes["feature"])
        if parent is not None:
            nodes[parent[1]][parent[0]] = here
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            for name, v in (("feature", -1), ("cut", 0.0), ("left", here), ("right", here), ("path", depth + average_path(len(rows)))):
                nodes[name].append(v)
            continue
        j = int(draw.choice(usable))
        cut = float(draw.uniform(low[j], high[j]))
        for name, v in (("feature", j), ("cut", cut), ("left", -1), ("right", -1), ("path", 0.0)):
            nodes[name].append(v)
        goes = x[rows, j] < cut
        waiting += [(rows[~goes], depth + 1, (here, "right")), (rows[goes], depth + 1, (here, "left"))]
    return {"tree": tree, **nodes}


def isolation_forest(df: DataFrame, row_id: str, features: str, trees: int = 100, sample: int = 256, seed: int = 42) -> list[dict]:
    """Fit: every tree draws its own ``sample`` rows by hash, at every size of the table; trees are grown in parallel.

    A row is drawn for a tree if its hash with the tree is below a threshold that lets some more than ``sample`` rows through; the
    first ``sample`` of them by hash are taken. The model is ``trees`` arrays of at most 2 x sample nodes, whatever the size of the table.
    """
    size = df.count()
    share = min(1.0, (sample + 6 * sample ** 0.5 + 20) / max(size, 1))
    key = hash31("id", seed)
    rows = df.select(F.col(row_id).alias("id"), F.col(features).cast("array<double>").alias("x")).withColumn("key", key)
    draw = lambda t: hash31(F.col("key") * 65536 + t, seed + 1)
    chosen = rows.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < int(share * M31))))
    chosen = cut_lineage(chosen.select("id", "x", "tree", draw(F.col("tree")).alias("drawn")))
    dealt = ordered.scan(chosen, ["tree"], ["drawn", "id"], [ordered.row_number("rn")], split=False).where(F.col("rn") <= sample).select("tree", "x")

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_grow(int(group["tree"].iloc[0]), np.stack(group["x"].to_numpy()), seed)])

    fitted = [r.asDict() for r in dealt.groupBy("tree").applyInPandas(grow, _TREE).collect()]
    for t in fitted:
        t["sample"] = min(size, sample)
    return sorted(fitted, key=lambda t: t["tree"])


def isolation_score(df: DataFrame, model: list[dict], features: str, name: str = "score") -> DataFrame:
    """Score in (0, 1]: 2 ^ (-mean path / expected path); higher is more anomalous. Whole Arrow batches at once."""
    forest = [
        (np.array(t["feature"]), np.array(t["cut"]), np.array(t["left"]), np.array(t["right"]), np.array(t["path"])) for t in model
    ]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    expected = max(average_path(model[0]["sample"]), 1e-9)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        m = np.stack(x.to_numpy()).astype(float)
        total = np.zeros(len(m))
        rows = np.arange(len(m))
        for feature, cut, left, right, path in shared.value:
            at = np.zeros(len(m), dtype=int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner & (m[rows, np.maximum(f, 0)] < cut[at]), left[at], np.where(inner, right[at], at))
            total += path[at]
        return pd.Series(2.0 ** (-total / len(shared.value) / expected))

    return df.withColumn(name, score(F.col(features).cast("array<double>")))


# ---- distance, density and reconstruction ---------------------------------------------

def _vector(features: str) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.col(features).cast("array<double>"))


def gaussian_envelope(df: DataFrame, features: str, width: int, trim: float = 0.1, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, inverse covariance) of the central rows: refit a few times without the ``trim`` most distant share.

    Sums are built by executors; only a width x width matrix reaches the driver.
    """
    rows = df.select(F.col(features).cast("array<double>").alias("x"))
    mean, inverse = _moments(rows, width)
    for _ in range(rounds):
        scored = rows.withColumn("d", mahalanobis("x", mean, inverse))
        cut = column_quantiles(scored, ["d"], [1 - trim])["d"][0]
        mean, inverse = _moments(scored.where(F.col("d") <= cut), width)
    return mean, inverse


def _moments(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    from pyspark.ml.stat import Correlation, Summarizer

    vectors = rows.select(_vector("x").alias("v"))
    row = vectors.select(Summarizer.metrics("mean", "std").summary(F.col("v")).alias("s")).first()["s"]
    mean, std = np.array(row["mean"]), np.array(row["std"])
    corr = np.nan_to_num(Correlation.corr(vectors, "v").first()[0].toArray())
    np.fill_diagonal(corr, 1.0)
    return mean, np.linalg.pinv(corr * np.outer(std, std))


def mahalanobis(features: Column | str, mean: np.ndarray, inverse: np.ndarray) -> Column:
    """Squared Mahalanobis distance; one matrix product per Arrow batch."""
    mean, inverse = np.asarray(mean, dtype=float), np.asarray(inverse, dtype=float)

    @F.pandas_udf("double")
    def distance(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        delta = np.stack(x.to_numpy()).astype(float) - mean
        return pd.Series(((delta @ inverse) * delta).sum(axis=1))

    return distance(col(features).cast("array<double>"))


def fourier_features(features: Column | str, width: int, count: int = 128, gamma: float | None = None, seed: int = 42) -> Column:
    """Random Fourier features of the RBF kernel exp(-gamma d^2) (Rahimi and Recht, 2007); gamma is 1/width if not given."""
    gamma = 1.0 / width if gamma is None else gamma
    draw = np.random.default_rng(seed)
    weights = draw.normal(0.0, math.sqrt(2 * gamma), (width, count))
    phase = draw.uniform(0, 2 * math.pi, count)

    @F.pandas_udf("array<double>")
    def lift(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        z = math.sqrt(2.0 / count) * np.cos(np.stack(x.to_numpy()).astype(float) @ weights + phase)
        return pd.Series(list(z))

    return lift(col(features).cast("array<double>"))


def kernel_outliers(df: DataFrame, features: str, width: int, nu: float = 0.1, gamma: float | None = None, seed: int = 42) -> DataFrame:
    """One-class rule in RBF feature space: flag the share ``nu`` of rows least similar to the mean of all.

    The mean in feature space is a vector of fixed length; the similarity to it is a Parzen density estimate.
    """
    from pyspark.ml.stat import Summarizer

    lifted = df.withColumn("__z", fourier_features(features, width, gamma=gamma, seed=seed))
    centre = lifted.select(Summarizer.mean(_vector("__z")).alias("m")).first()["m"]
    mean = F.array(*[F.lit(float(v)) for v in centre])
    similarity = F.aggregate(F.zip_with("__z", mean, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return flag_share(lifted.withColumn("similarity", similarity).drop("__z"), "similarity", nu, high=False)


def mixture_outliers(df: DataFrame, features: str, components: int = 2, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Rows of lowest likelihood under a Gaussian mixture fitted by the ML library."""
    from pyspark.ml.clustering import GaussianMixture

    vectors = df.withColumn("__v", _vector(features))
    model = GaussianMixture(featuresCol="__v", k=components, seed=seed, maxIter=50).fit(vectors)
    densities = []
    for w, g in zip(model.weights, model.gaussians):
        cov = g.cov.toArray()
        norm = math.log(max(w, 1e-300)) - 0.5 * (len(cov) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1])
        densities.append(F.lit(norm) - 0.5 * mahalanobis(features, np.array(g.mean), np.linalg.pinv(cov)))
    top = F.greatest(*densities) if len(densities) > 1 else densities[0]
    likelihood = top + F.log(sum((F.exp(d - top) for d in densities), F.lit(0.0)))
    return flag_share(df.withColumn("log_likelihood", likelihood), "log_likelihood", contamination, high=False)


def reconstruction_error(df: DataFrame, features: str, width: int, k: int) -> DataFrame:
    """Squared error of each row after projection on the first k principal components."""
    from pyspark.ml.functions import vector_to_array

    from gridlens.operators.selection import pca

    vectors = df.withColumn("__v", _vector(features))
    model, _, k = pca(vectors, "__v", k=k, width=width)
    scored = model.transform(vectors)
    square = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda s, v: s + v * v)
    # Components are orthonormal, so the lost square is the whole square less the kept one.
    return scored.withColumn("error", F.greatest(square("centred") - square("components"), F.lit(0.0))).drop("__v", "centred", "components")


# ---- rule scores -------------------------------------------------------------------------

def composite_score(df: DataFrame, order: list[str], columns: list[str], z: float = 2.5, tail: float = 0.05,
                    jump: float = 0.9) -> DataFrame:
    """Rule count per row: |z| above a limit, above or below the tail quantiles, and large moves from the row before.

    A row with a score of at least 1 is an anomaly. Constant columns add nothing.
    """
    moments = agg_row(df, {(t, c): f(c) for c in columns for t, f in (("m", F.avg), ("s", F.stddev_pop))})
    varied = [c for c in columns if moments[("s", c)]]
    before = ordered.scan(df, [], order, [ordered.lag(f"__p_{c}", c) for c in varied])
    tails = column_quantiles(before, varied, [tail, 1 - tail])
    moves = {f"__d_{c}": F.coalesce(F.abs(F.col(c) - F.col(f"__p_{c}")), F.lit(0.0)) for c in varied}
    moved = before.withColumns(moves)
    jumps = column_quantiles(moved, list(moves), [jump])
    score = F.lit(0)
    for c in varied:
        x = F.col(c)
        low, high = tails[c]
        rules = [
            F.abs((x - F.lit(moments[("m", c)])) / F.lit(moments[("s", c)])) > z, x > F.lit(high), x < F.lit(low),
            F.col(f"__p_{c}").isNotNull() & (F.col(f"__d_{c}") > F.lit(jumps[f"__d_{c}"][0])),
        ]
        for rule in rules:
            score = score + F.coalesce(rule.cast("int"), F.lit(0))
    return moved.select(*df.columns, score.alias("rule_score"), (score >= 1).cast("int").alias("anomaly"))


def row_outliers(df: DataFrame, features: str, share: float = 0.15, extremes: bool = True) -> DataFrame:
    """Rows whose mean, deviation or maximum is above, or minimum below, the stated quantile of all rows."""
    stats = row_stats(features)
    rows = df.withColumns(stats)
    names = ["row_mean", "row_std"] + (["row_min", "row_max"] if extremes else [])
    cuts = column_quantiles(rows, names, [share, 1 - share])
    hit = F.lit(False)
    for n in names:
        hit = hit | ((F.col(n) < F.lit(cuts[n][0])) if n == "row_min" else (F.col(n) > F.lit(cuts[n][1])))
    return rows.withColumn("anomaly", hit.cast("int"))


def principal_outliers(df: DataFrame, features: str, width: int, low: float = 0.3, needed: int = 2) -> DataFrame:
    """Per-feature correlation with the first principal component, its rule |corr| < low, and the resulting flag.

    The rule looks at columns, so every row gets the same score: the number of weak columns.
    """
    from pyspark.ml.functions import vector_to_array

    from gridlens.operators.selection import pca

    vectors = df.withColumn("__v", _vector(features))
    model, _, _ = pca(vectors, "__v", k=1, width=width)
    scored = model.transform(vectors).withColumn("__pc1", vector_to_array("components")[0])
    x = F.col(features).cast("array<double>")
    corr = agg_row(scored, {j: correlation(x[j], F.col("__pc1")) for j in range(width)}, batch=100)
    weak = sum(1 for v in corr.values() if v is not None and not math.isnan(v) and abs(v) < low)
    return df.select("*", F.lit(weak).alias("rule_score"), F.lit(int(weak >= needed)).alias("anomaly"))


def consensus(df: DataFrame, flags: list[str]) -> DataFrame:
    """Share flagged by each detector and by all of them together."""
    from gridlens.operators.profile import long_form

    every = F.lit(True)
    for f in flags:
        every = every & F.col(f)
    rates = {f: {"n_flagged": F.count(F.when(F.col(f), 1)), "rate": F.avg(F.col(f).cast("double"))} for f in flags}
    rates["all"] = {"n_flagged": F.count(F.when(every, 1)), "rate": F.avg(every.cast("double"))}
    return long_form(df, rates, label="detector")


def event_vector(source: str, severity: str, size: str, kind: str, success: Column) -> Column:
    """[hash(source) mod 1000, severity, size, length of the type, success] as an array."""
    return F.array(
        F.pmod(F.xxhash64(source), F.lit(1000)).cast("double"), F.col(severity).cast("double"), F.col(size).cast("double"),
        F.length(kind).cast("double"), success.cast("double"),
    )
