"""Privacy transforms and information-theoretic comparison of a table with its transformed copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.aggregates import correlation
from gridlens.functions.hashing import laplace, unit
from gridlens.functions.scalar import clip
from gridlens.operators.clean import replace_columns
from gridlens.operators.profile import long_form
from gridlens.operators.quantiles import agg_row

#: Fixed value: modulus of the numeric masking.
MASK_MODULUS = 1e9 + 7


def laplace_noise(df: DataFrame, row_id: str, columns: list[str], epsilon: float, sensitivity: float | None = None,
                  seed: int = 42) -> DataFrame:
    """Add Laplace noise of scale sensitivity / epsilon; the sensitivity is the column's whole range unless given.

    The noise is a function of row id and seed, so that a re-run gives the same rows: whoever knows both can take it off. Pass a
    secret seed, and don't publish it with the result.
    """
    if sensitivity is None:
        ends = agg_row(df, {c: F.max(c) - F.min(c) for c in columns})
    else:
        ends = {c: sensitivity for c in columns}
    return replace_columns(df, {
        c: F.col(c) + laplace(row_id, seed + j, F.lit(float(ends[c] or 0.0) / epsilon)) for j, c in enumerate(columns)
    })


def mask_numeric(df: DataFrame, row_id: str, columns: list[str], key: int = 617, seed: int = 42) -> DataFrame:
    """Multiplicative masking ``(x * key * noise) mod (1e9 + 7)`` with noise in [0.999, 1.001].

    This hides values from a casual look; it is no encryption and cannot be computed on.
    """
    noise = lambda j: F.lit(0.999) + F.lit(0.002) * unit(row_id, seed + j)
    return replace_columns(df, {
        c: F.pmod(F.col(c).cast("double") * key * noise(j), F.lit(MASK_MODULUS)) for j, c in enumerate(columns)
    })


def entropy_redundancy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shannon entropy (bits) of each column's values taken as shares of their sum, and 1 - H / log2(distinct).

    With S = sum(x), H = log2(S) - sum(x log2 x) / S, so one pass suffices. Values that are not positive add nothing.
    """
    stats = {}
    for c in columns:
        x = F.when(F.col(c) > 0, F.col(c).cast("double"))
        total = F.sum(x)
        h = F.log2(total) - F.sum(x * F.log2(x)) / total
        stats[c] = {"entropy": h, "redundancy": F.lit(1.0) - F.try_divide(h, F.log2(F.count_distinct(F.col(c)).cast("double")))}
    return long_form(df, stats, batch=10)


def kl_divergence(df: DataFrame, pairs: dict[str, tuple[str, str]], floor: float = 1e-10) -> DataFrame:
    """KL divergence (nats) of each column's share of its sum against its transformed twin's, both clipped to [floor, 1].

    The clipped shares are normalised again, as an entropy of two vectors does.
    """
    totals = agg_row(df, {**{("p", n): F.sum(F.col(a).cast("double")) for n, (a, _) in pairs.items()},
                          **{("q", n): F.sum(F.col(b).cast("double")) for n, (_, b) in pairs.items()}})
    stats = {}
    for n, (a, b) in pairs.items():
        share = lambda c, t: clip(F.coalesce(F.try_divide(F.col(c).cast("double"), F.lit(totals[(t, n)])), F.lit(0.0)), floor, 1.0)
        p, q = share(a, "p"), share(b, "q")
        sp, sq = F.sum(p), F.sum(q)
        stats[n] = {"kl": F.sum(p * F.log(p / q)) / sp - F.log(sp / sq)}
    return long_form(df, stats, label="column_name")


def cosine_columns(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Cosine similarity and distance of each column with its twin; a missing one takes the mean over columns.

    ``scaled`` is the similarity standardised over columns (population deviation) and clipped to [-2, 3].
    """
    wanted = {}
    for n, (a, b) in pairs.items():
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        wanted[n] = F.try_divide(F.sum(F.when(both, x * y)), F.sqrt(F.sum(F.when(both, x * x)) * F.sum(F.when(both, y * y))))
    found = agg_row(df, wanted)
    known = [v for v in found.values() if v is not None]
    mean = sum(known) / len(known) if known else 0.0
    values = {n: (mean if v is None else v) for n, v in found.items()}
    centre = sum(values.values()) / len(values)
    spread = (sum((v - centre) ** 2 for v in values.values()) / len(values)) ** 0.5
    rows = [
        (n, float(v), float(1 - v), float(min(3.0, max(-2.0, (v - centre) / spread if spread > 1e-15 else 0.0))))
        for n, v in values.items()
    ]
    return df.sparkSession.createDataFrame(rows, "column_name string, similarity double, distance double, scaled double")


def before_after_stats(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Mean, deviation, min and max of each column before and after a transform, one row per column."""
    def side(c: str, tag: str) -> dict[str, Column]:
        x = F.col(c).cast("double")
        return {f"mean_{tag}": F.avg(x), f"std_{tag}": F.stddev_samp(x), f"min_{tag}": F.min(x), f"max_{tag}": F.max(x)}

    return long_form(df, {n: {**side(a, "before"), **side(b, "after")} for n, (a, b) in pairs.items()})


def mean_shift_bands(stats: DataFrame) -> DataFrame:
    """10th, 50th and 90th percentile of the absolute mean shift over columns, and each column's band."""
    shift = F.abs(F.col("mean_after") - F.col("mean_before"))
    rows = [(r[0], r[1]) for r in stats.select("column_name", shift).collect()]  # one row per column
    cuts = stats.select(shift.alias("s")).agg(F.percentile("s", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))).first()[0]
    band = lambda s: "low" if s <= cuts[0] else "mid" if s <= cuts[1] else "high" if s <= cuts[2] else "extreme"
    return stats.sparkSession.createDataFrame(
        [(c, float(s), band(s), *map(float, cuts)) for c, s in rows],
        "column_name string, mean_shift double, band string, p10 double, p50 double, p90 double",
    )


def correlation_change(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Correlation of each pair of columns before and after the transform."""
    names = list(pairs)
    wanted = {}
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            wanted[(a, b, 0)] = correlation(pairs[a][0], pairs[b][0])
            wanted[(a, b, 1)] = correlation(pairs[a][1], pairs[b][1])
    found = agg_row(df, wanted, batch=100)
    rows = [(a, b, found[(a, b, 0)], found[(a, b, 1)]) for i, a in enumerate(names) for b in names[i + 1:]]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, corr_before double, corr_after double")
