"""Correlation of all pairs of columns in a number of passes that does not grow with the pairs."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.aggregates import correlation
from gridlens.operators.quantiles import agg_row

#: Up to this many columns, one aggregate with one expression per pair is the cheaper plan.
NARROW = 12


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of each pair (earlier, later) over rows where both are known; null for constants."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    if len(columns) <= NARROW:
        return agg_row(df, {p: correlation(*p) for p in pairs}, batch=100)
    return _by_gram(df, columns, pairs)


def _by_gram(df, columns, pairs):
    """One Gram matrix of centred values, known-flags and squares holds every pairwise sum.

    Executors add up the products in a tree; one matrix of (3 x columns) squared reaches the driver. Without
    nulls, centred values alone are enough.
    """
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    stats = agg_row(df, {"n": F.count(F.lit(1)), **{("c", c): F.count(c) for c in columns}, **{("m", c): F.avg(c) for c in columns},
                         **{("s", c): F.stddev_pop(c) for c in columns}})
    whole = all(stats[("c", c)] == stats["n"] for c in columns)
    # Columns are scaled to unit spread, so that products of very different sizes keep their digits.
    spread = {c: stats[("s", c)] or 1.0 for c in columns}
    x = [F.coalesce((F.col(c).cast("double") - F.lit(stats[("m", c)] or 0.0)) / F.lit(spread[c]), F.lit(0.0)) for c in columns]
    parts = list(x)
    if not whole:
        parts += [F.col(c).isNotNull().cast("double") for c in columns] + [v * v for v in x]
    vectors = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(F.array(*parts)).alias("v")), "v")
    gram = RowMatrix(vectors).computeGramianMatrix().toArray()
    k = len(columns)
    xy = gram[:k, :k]
    if whole:
        n, sx, sxx = np.full((k, k), float(stats["n"])), np.zeros((k, k)), np.tile(np.diag(xy)[:, None], (1, k))
    else:
        known = slice(k, 2 * k)
        n, sx, sxx = gram[known, known], gram[:k, known], gram[2 * k:, known]
    out = {}
    place = {c: i for i, c in enumerate(columns)}
    for a, b in pairs:
        i, j = place[a], place[b]
        m = n[i, j]
        vx, vy = m * sxx[i, j] - sx[i, j] ** 2, m * sxx[j, i] - sx[j, i] ** 2
        flat = vx <= 1e-12 * m * m or vy <= 1e-12 * m * m or not stats[("s", a)] or not stats[("s", b)]
        out[(a, b)] = None if m == 0 or flat else float((m * xy[i, j] - sx[i, j] * sx[j, i]) / (vx * vy) ** 0.5)
    return out
