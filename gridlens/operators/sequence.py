"""Ordered-sequence features: inter-arrival times, capture summaries, bursts, runs and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.scalar import from_micros, micros, ratio
from gridlens.operators import ordered
from gridlens.operators.quantiles import column_quantiles, group_quantiles


def inter_arrival(df: DataFrame, by: list[str], ts: str, row_id: str, name: str = "iat_s") -> DataFrame:
    """Seconds since the previous packet of the group; null for the first one."""
    timed = df.withColumn("__us", micros(ts))
    gaps = ordered.scan(timed, by, ["__us", row_id], [ordered.lag("__before", "__us")])
    return gaps.withColumn(name, (F.col("__us") - F.col("__before")) / 1e6).drop("__us", "__before")


def capture_summary(df: DataFrame, by: list[str], ts: str, row_id: str, length: str) -> DataFrame:
    """Packets, bytes, duration, rates and inter-arrival mean and deviation (ms) per capture.

    Captures with fewer than two packets are dropped; rates are 0 where the duration is 0.
    """
    gaps = inter_arrival(df, by, ts, row_id)
    out = gaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(length).alias("bytes"),
        ((F.max(micros(ts)) - F.min(micros(ts))) / 1e6).alias("duration_s"),
        (F.avg("iat_s") * 1000).alias("iat_mean_ms"), (F.stddev_pop("iat_s") * 1000).alias("iat_std_ms"),
    ).where("packets >= 2")
    return out.withColumns({
        "bytes_per_s": ratio("bytes", "duration_s"), "packets_per_s": ratio("packets", "duration_s"),
    })


def capture_summary_extended(df: DataFrame, by: list[str], ts: str, row_id: str, length: str, flow: list[str]) -> DataFrame:
    """:func:`capture_summary` plus gap extremes and variance, bit rate, packet sizes and flow count.

    With its one distinct count the aggregate is planned as partial rows per (capture, flow)
    that merge per capture, so a busy capture is combined before it reaches one task.
    """
    gaps = inter_arrival(df, by, ts, row_id)
    x, n = F.col("iat_s"), F.col(length).cast("double")
    out = gaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(n).alias("bytes"),
        F.count_distinct(F.struct(*flow)).alias("flow_count"),
        ((F.max(micros(ts)) - F.min(micros(ts))) / 1e6).alias("duration_s"),
        (F.avg(x) * 1000).alias("iat_mean_ms"), (F.min(x) * 1000).alias("iat_min_ms"),
        (F.max(x) * 1000).alias("iat_max_ms"), (F.stddev_pop(x) * 1000).alias("jitter_ms"),
        (F.var_pop(x) * 1e6).alias("iat_variance"),
        F.avg(n).alias("size_mean"), F.min(n).alias("size_min"), F.max(n).alias("size_max"),
        F.stddev_pop(n).alias("size_std"),
    ).where("packets >= 2")
    return out.withColumns({
        "packets_per_s": ratio("packets", "duration_s"), "bytes_per_s": ratio("bytes", "duration_s"),
        "mbps": ratio(F.col("bytes") * 8, F.col("duration_s") * 1e6),
    })


def burst_factor(df: DataFrame, by: list[str], ts: str, row_id: str, flow: list[str]) -> DataFrame:
    """90th percentile gap (ms) and share of gaps below the 25th percentile; 0 with fewer than two flows."""
    gaps = inter_arrival(df, by, ts, row_id).where("iat_s is not null")
    cuts = group_quantiles(gaps, by, "iat_s", [0.25, 0.9])
    flows = df.select(*by, *flow).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("flow_count"))
    share = gaps.join(cuts, by).groupBy(*by).agg(
        F.max(F.col("q")[1]).alias("p90"), F.avg((F.col("iat_s") < F.col("q")[0]).cast("double")).alias("below")
    )
    several = F.col("flow_count") >= 2
    return flows.join(share, by).select(
        *by, "flow_count",
        F.when(several, F.col("p90") * 1000).otherwise(0.0).alias("propagation_ms"),
        F.when(several, F.col("below")).otherwise(0.0).alias("burst_factor"),
    )


def burst_intensity(df: DataFrame, by: list[str], ts: str, row_id: str, gap_s: float = 0.05) -> DataFrame:
    """Share of gaps under 50 ms and share under the median gap; 0 with fewer than ten gaps."""
    gaps = inter_arrival(df, by, ts, row_id).where("iat_s is not null")
    medians = group_quantiles(gaps, by, "iat_s", [0.5])
    enough = F.col("n_gaps") >= 10
    return gaps.join(medians, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_gaps"),
        F.avg((F.col("iat_s") < gap_s).cast("double")).alias("__i"),
        F.avg((F.col("iat_s") < F.col("q")[0]).cast("double")).alias("__r"),
    ).select(
        *by, "n_gaps", F.when(enough, F.col("__i")).otherwise(0.0).alias("intensity"),
        F.when(enough, F.col("__r")).otherwise(0.0).alias("ratio"),
    )


def rtt_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Median round trip and half of it, from :func:`gridlens.operators.joins.syn_ack_pairs`."""
    medians = group_quantiles(pairs, by, "rtt_ms", [0.5])
    counts = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"))
    return counts.join(medians, by).select(
        *by, "n_pairs", F.col("q")[0].alias("rtt_ms"), (F.col("q")[0] / 2).alias("one_way_ms")
    )


def difference_flags(df: DataFrame, order: list[str], value: str, p1: float = 0.9, p2: float = 0.85) -> DataFrame:
    """First and second differences in row order, flagged above a percentile of their absolute values.

    The first row's first difference is 0; second differences start at the second row.
    """
    x = F.col(value).cast("double")
    first = ordered.scan(df, [], order, [ordered.lag("__x1", x), ordered.row_number("__rn")])
    first = first.withColumn("diff1", F.when(F.col("__rn") == 1, F.lit(0.0)).otherwise(x - F.col("__x1")))
    second = ordered.scan(first, [], order, [ordered.lag("__d1", "diff1")])
    second = second.withColumn("diff2", F.col("diff1") - F.col("__d1"))
    cut = column_quantiles(second.select(F.abs("diff1").alias("a"), F.abs("diff2").alias("b")), ["a", "b"], sorted({p1, p2}))
    at = dict(zip(sorted({p1, p2}), range(2)))
    cut1, cut2 = cut["a"][at[p1]], cut["b"][at[p2]]
    return second.withColumns({
        "flag1": F.coalesce((F.col("__rn") > 1) & (F.abs("diff1") > F.lit(cut1)), F.lit(False)),
        "flag2": F.coalesce((F.col("__rn") > 2) & (F.abs("diff2") > F.lit(cut2)), F.lit(False)),
    }).drop("__x1", "__rn", "__d1")


def temporal_edges(df: DataFrame, order: list, row_id: str, anomalous) -> DataFrame:
    """Edge from each anomalous row to the row after it."""
    # The next row is the previous one in reversed order.
    reverse = [F.col(o).desc() if isinstance(o, str) else o for o in order]
    ahead = ordered.scan(df, [], reverse, [ordered.lag("dst", row_id)])
    return ahead.where(anomalous & F.col("dst").isNotNull()).select(F.col(row_id).alias("src"), "dst")


def run_lengths(df: DataFrame, order: list[str], value: str, row_id: str) -> DataFrame:
    """Run-length encoding in row order: run number, value, length and first row id."""
    marked = ordered.scan(df, [], order, [ordered.lag("__p", value), ordered.row_number("__rn")])
    change = F.when((F.col("__rn") == 1) | ~F.col("__p").eqNullSafe(F.col(value)), 1).otherwise(0)
    # A run starts where the value changes; run ends follow from the next start, so only starts are sorted on.
    starts = marked.where(change == 1).select(F.col("__rn").alias("__at"), F.col(row_id).alias("first_id"), F.col(value).alias("value"))
    total = df.count()
    follow = ordered.scan(starts, [], [F.col("__at").desc()], [ordered.lag("__next", "__at")])
    numbered = ordered.scan(follow, [], ["__at"], [ordered.row_number("run")])
    return numbered.select("run", "value", "first_id", (F.coalesce("__next", F.lit(total + 1)) - F.col("__at")).alias("length"))


def recent(df: DataFrame, ts: str, row_id: str, n: int) -> DataFrame:
    """The n latest rows (a top-n, never a full sort)."""
    return df.orderBy(F.desc(ts), F.desc(row_id)).limit(n)


def latest_per_source(df: DataFrame, source: str, ts: str, row_id: str, keep: list[str]) -> DataFrame:
    """The last row of each source as a map-side maximum; no sort, no window."""
    newest = df.groupBy(source).agg(F.max(F.struct(ts, row_id, *keep)).alias("r"))
    return newest.select(source, f"r.{ts}", f"r.{row_id}", *[f"r.{k}" for k in keep])


def sessions(df: DataFrame, by: list[str], ts: str, row_id: str, gap_s: float) -> DataFrame:
    """Start, end and size of each run of rows whose gaps are at most ``gap_s`` seconds.

    Sessions are numbered by a running count of starts, then reduced; a busy source may
    span any number of blocks.
    """
    gaps = inter_arrival(df, by, ts, row_id)
    started = gaps.withColumn("__start", (F.col("iat_s").isNull() | (F.col("iat_s") > gap_s)).cast("int"))
    numbered = ordered.scan(started, by, [ts, row_id], [ordered.running("session", "sum", "__start")])
    return numbered.groupBy(*by, "session").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("n")
    )


def trend(df: DataFrame, ts: str, value: str, unit: str = "day") -> DataFrame:
    """Mean per time bucket and its change from the bucket before (one row per bucket is windowed)."""
    means = df.groupBy(F.date_trunc(unit, ts).cast("timestamp_ntz").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")
    )
    return ordered.scan(means, [], ["bucket"], [ordered.lag("__m", "mean")]).select(
        "bucket", "n", "mean", (F.col("mean") - F.col("__m")).alias("delta")
    )


def row_time_index(df: DataFrame, order: list[str], start: str, name: str = "row_time") -> DataFrame:
    """A time per row: the start plus one second per preceding row."""
    placed = ordered.scan(df, [], order, [ordered.row_number("__rn")])
    base = micros(F.lit(start).cast("timestamp"))
    return placed.withColumn(name, from_micros(base + (F.col("__rn") - 1) * 1000000)).drop("__rn")


def over_rate(df: DataFrame, source: str, ts: str, max_rate: int) -> DataFrame:
    """(source, second) pairs with more than ``max_rate`` packets."""
    second = F.date_trunc("second", ts).cast("timestamp_ntz").alias("second")
    return df.groupBy(source, second).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_rate)
