"""Aggregations, windows, sorting, set operations, flow features, joins and graphs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions.hashing import hash31_sql
from gridlens.functions.scalar import micros
from gridlens.operators import graph, joins, ordered, profile, rules, sequence
from gridlens.plans.common import ALERTS_SQL, NUMERIC, PACKETS_SQL, event_alerts, packets, rounded
from gridlens.plans.registry import query


def per_column(columns, body, table):
    """UNION ALL of one SELECT per column; {c} in the body is the column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, " + body.replace("{c}", c) + f" FROM {table}" for c in columns)


# ---- aggregations ------------------------------------------------------------------

@query("describe_numeric", per_column(NUMERIC, """count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75,
  max({c}) AS max""", "lineitem"))
def _(t):
    return rounded(profile.describe(t.lineitem, NUMERIC), ["mean", "std", "q25", "q50", "q75"])


@query("stats_advanced", per_column(NUMERIC, """round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
  round(stddev_samp({c}), 4) AS std, round(var_samp({c}), 2) + 0.0 AS variance, round(skewness({c}), 4) + 0.0 AS skewness, round(kurtosis({c}), 4) AS kurtosis""", "lineitem"))
def _(t):
    found = profile.advanced_stats(t.lineitem, NUMERIC)
    return rounded(rounded(found, ["mean", "median", "std", "skewness", "kurtosis"]), ["variance"], 2)


HOLED_SQL = "holed AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value, CASE WHEN user_id % 4 = 0 THEN NULL ELSE event_type END AS event_type FROM events)"


def _holed(t):
    return t.events.select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"),
                           F.when(F.col("user_id") % 4 != 0, F.col("event_type")).alias("event_type"))


@query("missing_profile", f"WITH {HOLED_SQL} " + per_column(
    ["event_id", "value", "event_type"], "count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS missing_pct", "holed"))
def _(t):
    return rounded(profile.missing_profile(_holed(t)), ["missing_pct"])


LINE_COLUMNS = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_suppkey"]


@query("distinct_profile", per_column(LINE_COLUMNS, "count(DISTINCT {c}) AS n_distinct", "lineitem"))
def _(t):
    return profile.distinct_profile(t.lineitem, LINE_COLUMNS)


@query("duplicate_rows", """
SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT *, count(*) AS n FROM (
  SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_quantity > 25) GROUP BY ALL)""")
def _(t):
    return profile.duplicate_rows(t.lineitem.unionByName(t.lineitem.where("l_quantity > 25")))  # rows repeated on purpose, all columns


@query("top_sources", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def _(t):
    return profile.value_counts(t.events, "user_id", 10)


@query("class_distribution", "SELECT event_type, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def _(t):
    return rounded(profile.class_distribution(t.events, "event_type"), ["share"], 6)


def _profile_sql():
    number = per_column(["l_quantity", "l_extendedprice"], """'numeric' AS kind, count(*) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_distinct,
      round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) + 0.0 AS skewness""", "lineitem")
    text = per_column(["l_returnflag", "l_linestatus"], """'text', count(*), count(*) - count({c}), count(DISTINCT {c}),
      NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE""", "lineitem")
    return number + " UNION ALL " + text


@query("data_profile", _profile_sql())
def _(t):
    found = profile.data_profile(t.lineitem, ["l_quantity", "l_extendedprice"], ["l_returnflag", "l_linestatus"])
    return rounded(found, ["mean", "median", "std", "skewness"])


@query("pattern_summary", f"""
WITH {PACKETS_SQL}, ranked AS (SELECT event_type, src, row_number() OVER (PARTITION BY event_type ORDER BY src) AS rn FROM (SELECT DISTINCT event_type, src FROM packets)),
l AS (SELECT event_type, count(*) AS n_sources, string_agg(src, ',' ORDER BY src) FILTER (rn <= 100) AS first_sources FROM ranked GROUP BY event_type)
SELECT event_type, count(*) AS n, round(avg(value), 4) AS severity_mean, round(stddev_pop(value), 4) AS severity_std,
  round(avg(length), 4) AS size_mean, round(stddev_pop(length), 4) AS size_std, any_value(n_sources) AS n_sources, any_value(first_sources) AS first_sources
FROM packets JOIN l USING (event_type) GROUP BY event_type""")
def _(t):
    found = profile.pattern_summary(packets(t.events), ["event_type"], "src", "value", "length")
    return rounded(found, ["severity_mean", "severity_std", "size_mean", "size_std"])


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM lineitem" for a in NUMERIC for b in NUMERIC))
def _(t):
    return rounded(profile.correlation_pairs(t.lineitem, NUMERIC), ["corr"], 6)


@query("top_variance", "SELECT * FROM (" + per_column(NUMERIC, "round(var_samp({c}), 4) AS variance", "lineitem") + ") ORDER BY variance DESC, column_name LIMIT 2")
def _(t):
    return rounded(profile.top_variance(t.lineitem, NUMERIC, 2), ["variance"])


def _quartile_sql(c):
    return (f"SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM lineitem")


@query("box_stats", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
  min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max({c}) FILTER ({c} <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outside FROM lineitem, ({_quartile_sql(c)})""" for c in NUMERIC))
def _(t):
    return rounded(profile.box_stats(t.lineitem, NUMERIC), ["q1", "median", "q3"])


@query("iqr_outliers", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT 'value' AS column_name, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers,
  round(count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) * 100.0::DOUBLE / count(value), 4) AS outlier_pct FROM events, q""")
def _(t):
    return rounded(profile.iqr_outliers(t.events, ["value"]), ["outlier_pct"])


@query("histogram", """
WITH r AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 50 AS w FROM events),
c AS (SELECT least(CAST(floor((value - lo) / w) AS INTEGER), 49) AS bin, count(*) AS n FROM events, r GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * w, 6) AS bin_low, coalesce(n, 0) AS n
FROM (SELECT unnest(range(50)) AS bin) g CROSS JOIN r LEFT JOIN c ON c.bin = g.bin""")
def _(t):
    return rounded(profile.histogram(t.events, "value", 50), ["bin_low"], 6)


@query("qq_points")
def _(t):
    return rounded(profile.qq_points(t.events, "value"), ["normal_quantile"])


def _jb(c, table):
    return f"""SELECT '{c}' AS column_name, n, round(jb, 3) AS jarque_bera, round(exp(-jb / 2), 6) AS p_value FROM (
      SELECT n, n / 6.0::DOUBLE * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM (
        SELECT count(*) AS n, avg(pow({c} - m, 2)) AS m2, avg(pow({c} - m, 3)) AS m3, avg(pow({c} - m, 4)) AS m4
        FROM {table}, (SELECT avg({c}) AS m FROM {table})))"""


@query("normality_jb", _jb("value", "events") + " UNION ALL " + _jb("event_id", "events"))
def _(t):
    return rounded(rounded(profile.normality(t.events, ["value", "event_id"]), ["jarque_bera"], 3), ["p_value"], 6)


@query("normality_ks")
def _(t):
    return profile.ks_normality(t.events, "value")


@query("welch_psd")
def _(t):
    return rounded(profile.welch_density(t.events.select("ts", "event_id", "value"), ["ts", "event_id"], "value"), ["power"])


@query("activity_by_hour", "SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return profile.activity(t.events, "ts", "hour")


@query("activity_by_day", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return profile.activity(t.events, "ts", "day")


@query("peak_activity", """
WITH c AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1),
m AS (SELECT avg(n) AS mean_n, avg(n) + 2 * stddev_samp(n) AS threshold FROM c)
SELECT bucket, n, round(mean_n, 4) AS mean_n, round(threshold, 4) AS threshold FROM c, m WHERE n > threshold ORDER BY n DESC, bucket LIMIT 10""")
def _(t):
    return rounded(profile.peak_buckets(profile.activity(t.events, "ts", "hour")), ["mean_n", "threshold"])


@query("flow_stats", " UNION ALL ".join(f"""SELECT '{n}' AS column_name, count({e}) AS n, round(avg({e}), 4) AS mean, round(stddev_samp({e}), 4) AS std,
  round(min({e}), 4) AS min, round(quantile_cont({e}, 0.25), 4) AS q25, round(quantile_cont({e}, 0.5), 4) AS q50, round(quantile_cont({e}, 0.75), 4) AS q75,
  round(max({e}), 4) AS max FROM lineitem"""
  for n, e in (("duration", "l_quantity"), ("packet_sum", "(l_quantity + l_discount + l_tax)"))))
def _(t):
    flows = t.lineitem.select(F.col("l_quantity").alias("duration"), (F.col("l_quantity") + F.col("l_discount") + F.col("l_tax")).alias("packet_sum"))
    return rounded(profile.describe(flows, ["duration", "packet_sum"]), ["mean", "std", "min", "q25", "q50", "q75", "max"])


@query("rate_by_type", "SELECT event_type, count(*) AS n, CAST(sum(CAST(value > 50 AS INTEGER)) AS BIGINT) AS n_true, round(avg(CAST(value > 50 AS INTEGER)), 6) AS rate FROM events GROUP BY event_type")
def _(t):
    return rounded(profile.rate_by(t.events, "event_type", F.col("value") > 50), ["rate"], 6)


@query("best_type", """
SELECT event_type AS best, round(rate, 6) AS rate FROM (SELECT event_type, avg(CAST(value > 50 AS INTEGER)) AS rate FROM events GROUP BY event_type)
ORDER BY rate DESC, event_type LIMIT 1""")
def _(t):
    rates = profile.rate_by(t.events, "event_type", F.col("value") > 50)
    return rounded(rates.orderBy(F.desc("rate"), "event_type").limit(1).select(F.col("event_type").alias("best"), "rate"), ["rate"], 6)


@query("crosstab_anomaly", """
SELECT event_type, count(*) FILTER (value <= 100) AS anomaly_0, count(*) FILTER (value > 100) AS anomaly_1 FROM events GROUP BY event_type""")
def _(t):
    rows = t.events.select("event_type", (F.col("value") > 100).cast("int").alias("anomaly"))
    return profile.crosstab(rows, "event_type", "anomaly", [0, 1])


@query("window_violation_rate", """
WITH p AS (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // 1000 AS batch, event_type = 'error' AS bad FROM events)
SELECT batch, count(*) AS n, CAST(sum(CAST(bad AS INTEGER)) AS BIGINT) AS n_true, round(avg(CAST(bad AS INTEGER)), 6) AS rate FROM p GROUP BY batch""")
def _(t):
    found = profile.batch_rate(t.events.select("ts", "event_id", "event_type"), ["ts", "event_id"], F.col("event_type") == "error")
    return rounded(found, ["rate"], 6)


@query("row_stats", """
SELECT vec_id, round(avg(x), 4) + 0.0 AS row_mean, round(stddev_pop(x), 4) AS row_std, round(min(x), 4) + 0.0 AS row_min, round(max(x), 4) + 0.0 AS row_max
FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY vec_id""")
def _(t):
    stats = profile.row_stats("embedding")
    return rounded(t.embeddings.select("vec_id", *[c.alias(n) for n, c in stats.items()]), list(stats))


# ---- windows and sequences -----------------------------------------------------------

@query("iat", """
SELECT event_id, user_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 6) AS iat_s FROM events""")
def _(t):
    return rounded(sequence.inter_arrival(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id").drop("ts"), ["iat_s"], 6)


@query("diff_flags", """
WITH a AS (SELECT event_id, value, row_number() OVER w AS rn, CASE WHEN row_number() OVER w = 1 THEN 0.0::DOUBLE ELSE value - lag(value) OVER w END AS diff1
  FROM events WINDOW w AS (ORDER BY ts, event_id)),
b AS (SELECT *, diff1 - lag(diff1) OVER (ORDER BY rn) AS diff2 FROM a),
q AS (SELECT quantile_cont(abs(diff1), 0.9) AS c1, quantile_cont(abs(diff2), 0.85) AS c2 FROM b)
SELECT event_id, round(diff1, 4) + 0.0 AS diff1, round(diff2, 4) + 0.0 AS diff2, rn > 1 AND abs(diff1) > c1 AS flag1,
  coalesce(rn > 2 AND abs(diff2) > c2, false) AS flag2 FROM b, q""")
def _(t):
    found = sequence.difference_flags(t.events.select("event_id", "ts", "value"), ["ts", "event_id"], "value")
    return rounded(found.select("event_id", "diff1", "diff2", "flag1", "flag2"), ["diff1", "diff2"])


@query("temporal_edges", """
SELECT src, dst FROM (SELECT event_id AS src, event_type, lead(event_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE event_type = 'error' AND dst IS NOT NULL""")
def _(t):
    return sequence.temporal_edges(t.events.select("event_id", "ts", "event_type"), ["ts", "event_id"], "event_id", F.col("event_type") == "error")


@query("rle", """
WITH m AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY ts, event_id) THEN 1 ELSE 0 END AS c FROM events),
g AS (SELECT *, sum(c) OVER (ORDER BY rn) AS run FROM m)
SELECT CAST(run AS BIGINT) AS run, any_value(event_type) AS value, arg_min(event_id, rn) AS first_id, count(*) AS length FROM g GROUP BY run""")
def _(t):
    return sequence.run_lengths(t.events.select("event_id", "ts", "event_type"), ["ts", "event_id"], "event_type", "event_id")


@query("recent_n", "SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(t):
    return sequence.recent(t.events.select("event_id", "ts", "user_id"), "ts", "event_id", 50)


@query("latest_per_source", "SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY user_id")
def _(t):
    return sequence.latest_per_source(t.events, "user_id", "ts", "event_id", ["event_type", "value"])


@query("running_totals", """
SELECT event_id, user_id, count(*) OVER w AS seen, round(sum(value) OVER w, 4) AS score, round(avg(CAST(event_type <> 'error' AS INTEGER)) OVER w, 4) AS accuracy
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    good = (F.col("event_type") != "error").cast("int")
    found = ordered.scan(t.events, ["user_id"], ["ts", "event_id"], [
        ordered.row_number("seen"), ordered.running("score", "sum", "value"), ordered.running("good", "sum", good)])
    return rounded(found.select("event_id", "user_id", "seen", "score", (F.col("good") / F.col("seen")).alias("accuracy")), ["score", "accuracy"])


@query("drift_trend", """
WITH b AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1)
SELECT bucket, n, round(mean, 4) AS mean, round(mean - lag(mean) OVER (ORDER BY bucket), 4) + 0.0 AS delta FROM b""")
def _(t):
    return rounded(sequence.trend(t.events, "ts", "value"), ["mean", "delta"])


@query("row_time_index", """
SELECT event_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(row_number() OVER (ORDER BY event_id) - 1) AS row_time FROM events""")
def _(t):
    return sequence.row_time_index(t.events.select("event_id"), ["event_id"], "2024-01-01 00:00:00")


# ---- sort, limit, sets -----------------------------------------------------------------

@query("top_events", "SELECT event_id, value, event_type FROM events ORDER BY value DESC, (event_type = 'error') DESC, event_id LIMIT 100")
def _(t):
    return t.events.select("event_id", "value", "event_type").orderBy(
        F.desc("value"), F.desc(F.col("event_type") == "error"), "event_id").limit(100)


@query("top_features_row", """
SELECT vec_id, pos, rn, round(x, 4) + 0.0 AS value FROM (
  SELECT vec_id, pos, x, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, pos) AS rn FROM (
    SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(range(64)) AS INTEGER) AS pos FROM embeddings)) WHERE rn <= 4""")
def _(t):
    # The order of one row's elements is found inside the row: no shuffle.
    pairs = F.transform("embedding", lambda x, i: F.struct((-F.abs(x.cast("double"))).alias("k"), i.alias("pos"), x.cast("double").alias("value")))
    top = t.embeddings.select("vec_id", F.posexplode(F.slice(F.array_sort(pairs), 1, 4)).alias("at", "f"))
    return rounded(top.select("vec_id", "f.pos", (F.col("at") + 1).cast("bigint").alias("rn"), "f.value"), ["value"])


@query("union_all", """
SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def _(t):
    a = t.customer.selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment")
    b = t.supplier.selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")
    return a.unionByName(b, allowMissingColumns=True)


@query("set_except", "SELECT DISTINCT user_id FROM events EXCEPT SELECT user_id FROM events WHERE value > 250")
def _(t):
    # Both sides come from one table, so the difference of the two sets is one aggregate.
    return t.events.groupBy("user_id").agg(F.max(F.coalesce(F.col("value") > 250, F.lit(False))).alias("hit")).where("not hit").select("user_id")


@query("set_intersect", "SELECT l_partkey AS key FROM lineitem INTERSECT SELECT o_custkey FROM orders")
def _(t):
    return t.lineitem.select(F.col("l_partkey").alias("key")).intersect(t.orders.select(F.col("o_custkey").alias("key")))


# ---- packet and flow features ------------------------------------------------------------

GAPS_SQL = """gaps AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS iat FROM events)"""

SUMMARY_SQL = f"""
WITH {GAPS_SQL}
SELECT user_id, count(*) AS packets, round(sum(value), 4) AS bytes, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 4) AS duration_s,
  round(avg(iat) * 1000, 1) AS iat_mean_ms, round(stddev_pop(iat) * 1000, 1) AS iat_std_ms,
  round(coalesce(sum(value) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 0), 6) AS bytes_per_s,
  round(coalesce(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 0), 6) AS packets_per_s
FROM gaps GROUP BY user_id HAVING count(*) >= 2"""


def capture_summary(t):
    found = sequence.capture_summary(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", "event_id", "value")
    found = rounded(found, ["bytes", "duration_s"])
    return rounded(rounded(found, ["iat_mean_ms", "iat_std_ms"], 1), ["bytes_per_s", "packets_per_s"], 6)


query("capture_summary", SUMMARY_SQL)(capture_summary)


@query("capture_summary_ext", f"""
WITH {GAPS_SQL}, d AS (SELECT user_id, count(*) AS packets, sum(value) AS bytes, count(DISTINCT event_type) AS flow_count,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS dur, avg(iat) AS m, min(iat) AS lo, max(iat) AS hi, stddev_pop(iat) AS s, var_pop(iat) AS v,
  avg(value) AS sm, min(value) AS smin, max(value) AS smax, stddev_pop(value) AS ss FROM gaps GROUP BY user_id HAVING count(*) >= 2)
SELECT user_id, packets, round(bytes, 4) AS bytes, flow_count, round(dur, 4) AS duration_s, round(m * 1000, 1) AS iat_mean_ms, round(lo * 1000, 3) AS iat_min_ms,
  round(hi * 1000, 3) AS iat_max_ms, round(s * 1000, 1) AS jitter_ms, round(v, 1) AS iat_variance, round(sm, 4) AS size_mean, smin AS size_min, smax AS size_max,
  round(ss, 4) AS size_std, round(coalesce(packets / nullif(dur, 0), 0), 6) AS packets_per_s, round(coalesce(bytes / nullif(dur, 0), 0), 6) AS bytes_per_s,
  round(coalesce(bytes * 8 / nullif(dur * 1e6, 0), 0), 9) AS mbps FROM d""")
def _(t):
    found = sequence.capture_summary_extended(t.events.drop("props"), ["user_id"], "ts", "event_id", "value", ["event_type"])
    found = found.withColumn("iat_variance", F.col("iat_variance") / 1e6)  # back to s^2: the digits of two engines agree
    found = rounded(found, ["bytes", "duration_s", "size_mean", "size_std"])
    found = rounded(rounded(found, ["iat_min_ms", "iat_max_ms"], 3), ["iat_mean_ms", "jitter_ms", "iat_variance"], 1)
    return rounded(rounded(found, ["packets_per_s", "bytes_per_s"], 6), ["mbps"], 9)


@query("burst_factor", f"""
WITH {GAPS_SQL}, q AS (SELECT user_id, quantile_cont(iat, 0.25) AS q25, quantile_cont(iat, 0.9) AS q90 FROM gaps WHERE iat IS NOT NULL GROUP BY user_id),
f AS (SELECT user_id, count(DISTINCT event_type) AS flow_count FROM events GROUP BY user_id)
SELECT user_id, any_value(flow_count) AS flow_count, CASE WHEN any_value(flow_count) >= 2 THEN round(any_value(q90) * 1000, 3) ELSE 0 END AS propagation_ms,
  CASE WHEN any_value(flow_count) >= 2 THEN round(avg(CAST(iat < q25 AS INTEGER)), 6) ELSE 0 END AS burst_factor
FROM gaps JOIN q USING (user_id) JOIN f USING (user_id) WHERE iat IS NOT NULL GROUP BY user_id""")
def _(t):
    found = sequence.burst_factor(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id", ["event_type"])
    return rounded(rounded(found, ["propagation_ms"], 3), ["burst_factor"], 6)


@query("burst_intensity", f"""
WITH {GAPS_SQL}, q AS (SELECT user_id, quantile_cont(iat, 0.5) AS q50 FROM gaps WHERE iat IS NOT NULL GROUP BY user_id)
SELECT user_id, count(*) AS n_gaps, CASE WHEN count(*) >= 10 THEN round(avg(CAST(iat < 0.05 AS INTEGER)), 6) ELSE 0 END AS intensity,
  CASE WHEN count(*) >= 10 THEN round(avg(CAST(iat < q50 AS INTEGER)), 6) ELSE 0 END AS ratio
FROM gaps JOIN q USING (user_id) WHERE iat IS NOT NULL GROUP BY user_id""")
def _(t):
    found = sequence.burst_intensity(t.events.select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id")
    return rounded(found, ["intensity", "ratio"], 6)


# Event times are minutes apart, so the check scales them: 1 s of the table counts as 1 ms.
PAIRS_SQL = f"""{PACKETS_SQL}, kept AS (SELECT *, ts_us // 1000 AS us, (flags & 2) <> 0 AS syn FROM packets WHERE (flags & 18) <> 0),
l AS (SELECT *, lag(syn) OVER w AS was_syn, lag(us) OVER w AS before_us FROM kept WINDOW w AS (PARTITION BY src, dst ORDER BY us, packet_id)),
pairs AS (SELECT packet_id, src, dst, (us - before_us) / 1000.0::DOUBLE AS rtt_ms FROM l WHERE NOT syn AND was_syn)"""


@query("rtt_pairs", f"WITH {PAIRS_SQL} SELECT packet_id, src, rtt_ms FROM pairs WHERE rtt_ms > 0 AND rtt_ms < 1000")
def _(t):
    return _pairs(t).select("packet_id", "src", "rtt_ms")


def _pairs(t):
    p = packets(t.events).withColumn("us", F.floor(F.col("ts_us") / 1000).cast("bigint"))
    return joins.syn_ack_pairs(p.select("packet_id", "src", "dst", "us", "flags"), ["src", "dst"], ["us", "packet_id"], "us", "flags")


@query("rtt_summary", f"""
WITH {PAIRS_SQL} SELECT src, count(*) AS n_pairs, round(quantile_cont(rtt_ms, 0.5), 6) AS rtt_ms, round(quantile_cont(rtt_ms, 0.5) / 2, 6) AS one_way_ms
FROM pairs WHERE rtt_ms > 0 AND rtt_ms < 1000 GROUP BY src""")
def _(t):
    return rounded(sequence.rtt_summary(_pairs(t), ["src"]), ["rtt_ms", "one_way_ms"], 6)


@query("traffic_by_source", f"WITH {PACKETS_SQL} SELECT src, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY src")
def _(t):
    return packets(t.events).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


@query("rate_limit", "SELECT user_id % 4 AS source, date_trunc('second', ts) AS second, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return sequence.over_rate(t.events.select(F.pmod("user_id", F.lit(4)).alias("source"), "ts"), "source", "ts", 1)


# ---- joins -----------------------------------------------------------------------------------

@query("join_flow_packet", """
SELECT l_orderkey, l_linenumber, l_quantity, o_custkey, o_orderpriority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    flows = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    return joins.enrich(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), flows, ["l_orderkey"])


@query("join_interval", """
WITH f AS (SELECT event_id AS flow_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + 3600000000 AS e FROM events WHERE event_type = 'signup')
SELECT flow_id, f.user_id, count(p.event_id) AS n_packets, round(coalesce(sum(value), 0), 4) AS value_sum
FROM f LEFT JOIN events p ON p.user_id = f.user_id AND event_type <> 'signup' AND epoch_us(p.ts) BETWEEN s AND e GROUP BY flow_id, f.user_id""")
def _(t):
    timed = t.events.select("event_id", "user_id", "event_type", "value", micros("ts").alias("us"))
    flows = timed.where("event_type = 'signup'").select(
        F.col("event_id").alias("flow_id"), "user_id", F.col("us").alias("s"), (F.col("us") + 3600 * 1000000).alias("e"))
    found = joins.packets_in_lifetime(timed.where("event_type <> 'signup'"), flows, ["user_id"], "us", "value", "s", "e", "flow_id")
    return rounded(found.select("flow_id", "user_id", "n_packets", "value_sum"), ["value_sum"])


@query("flow_of_packet", """
WITH f AS (SELECT event_id AS flow_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + 3600000000 AS e FROM events WHERE event_type = 'signup'),
m AS (SELECT p.event_id, p.user_id, epoch_us(p.ts) AS us, f.flow_id, f.s, f.e FROM events p
  ASOF LEFT JOIN f ON p.user_id = f.user_id AND epoch_us(p.ts) >= f.s WHERE p.event_type <> 'signup')
SELECT event_id, user_id, us, CASE WHEN us <= e THEN flow_id END AS flow_id FROM m""")
def _(t):
    timed = t.events.select("event_id", "user_id", "event_type", micros("ts").alias("us"))
    flows = timed.where("event_type = 'signup'").select(
        F.col("event_id").alias("flow_id"), "user_id", F.col("us").alias("s"), (F.col("us") + 3600 * 1000000).alias("e"))
    return joins.flow_of_packet(timed.where("event_type <> 'signup'"), flows, ["user_id"], "us", "event_id", "s", "e", "flow_id")


@query("join_semi", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 250)")
def _(t):
    return rules.include(t.events.select("event_id", "user_id"), t.events.where("value > 250"), ["user_id"])


@query("join_anti", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 250)")
def _(t):
    return rules.exclude(t.events.select("event_id", "user_id"), t.events.where("value > 250"), ["user_id"])


@query("join_pred_truth", "SELECT doc_id, lang, quality AS truth, toxic AS predicted FROM labels JOIN documents USING (doc_id)")
def _(t):
    truth = t.labels.select("doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("predicted"))
    return joins.align_predictions(truth, t.documents.select("doc_id", "lang"), "doc_id")


# ---- graph ---------------------------------------------------------------------------------------

@query("graph_edges", "SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem")
def _(t):
    return graph.undirected_edges(t.lineitem, "l_suppkey", "l_partkey")


@query("degree_histogram", """
WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem),
d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node)
SELECT degree, count(*) AS n_nodes FROM d GROUP BY degree""")
def _(t):
    return graph.degree_histogram(graph.undirected_edges(t.lineitem, "l_suppkey", "l_partkey"))


@query("graph_metrics", """
WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem),
n AS (SELECT count(*) AS n FROM (SELECT a FROM e UNION SELECT b FROM e)), m AS (SELECT count(*) AS m FROM e)
SELECT n AS n_nodes, m AS n_edges, round(2.0::DOUBLE * m / n, 6) AS avg_degree, round(2.0::DOUBLE * m / (n * (n - 1)), 6) AS density FROM n, m""")
def _(t):
    return rounded(graph.graph_metrics(graph.undirected_edges(t.lineitem, "l_suppkey", "l_partkey")), ["avg_degree", "density"], 6)


# Customers, linked to the days of their orders; the two kinds of nodes have even and odd numbers.
COMPONENT_SQL = """edges AS (SELECT DISTINCT o_custkey * 2 AS a, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) * 2 + 1 AS b
  FROM orders),
twoway AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges)"""


def _component_edges(t):
    rows = t.orders.select(
        (F.col("o_custkey") * 2).alias("c"), (F.floor(micros("o_orderdate") / 86400000000).cast("bigint") * 2 + 1).alias("d"))
    return graph.undirected_edges(rows, "c", "d")


@query("graph_components", f"""
WITH RECURSIVE {COMPONENT_SQL}, reach(node, root) AS (
  SELECT a, a FROM twoway UNION SELECT t.b, reach.root FROM reach JOIN twoway t ON t.a = reach.node AND t.b > reach.root)
SELECT node, min(root) AS component FROM reach GROUP BY node""")
def _(t):
    return graph.components(_component_edges(t))


@query("largest_component", f"""
WITH RECURSIVE {COMPONENT_SQL}, reach(node, root) AS (
  SELECT a, a FROM twoway UNION SELECT t.b, reach.root FROM reach JOIN twoway t ON t.a = reach.node AND t.b > reach.root)
SELECT component, count(*) AS n_nodes FROM (SELECT node, min(root) AS component FROM reach GROUP BY node) GROUP BY component ORDER BY n_nodes DESC, component LIMIT 1""")
def _(t):
    return graph.component_sizes(graph.components(_component_edges(t))).orderBy(F.desc("n_nodes"), "component").limit(1)


@query("graph_sample", f"""
WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem),
n AS (SELECT node FROM (SELECT a AS node FROM e UNION SELECT b FROM e) ORDER BY {hash31_sql('node', 42)}, node LIMIT 500)
SELECT a, b FROM e WHERE a IN (SELECT node FROM n) AND b IN (SELECT node FROM n)""")
def _(t):
    return graph.node_sample(graph.undirected_edges(t.lineitem, "l_suppkey", "l_partkey"), 500)


# ---- batch twins of the streaming rules -------------------------------------------------------------

@query("auto_block", f"""
WITH {ALERTS_SQL}, firsts AS (SELECT user_id, min(ts) AS block_ts FROM alerts WHERE confidence > 0.9 GROUP BY user_id)
SELECT a.event_id, a.user_id, a.ts, a.confidence, coalesce(a.ts = block_ts, false) AS blocks FROM alerts a LEFT JOIN firsts f ON f.user_id = a.user_id WHERE block_ts IS NULL OR a.ts <= block_ts""")
def _(t):
    alerts = event_alerts(t.events).select("event_id", "user_id", "ts", "confidence")
    return rules.auto_block(alerts, "user_id", ["ts", "event_id"], "confidence", 0.9)


@query("sliding_activity", """
SELECT w AS window_start, count(*) AS n FROM (
  SELECT time_bucket(INTERVAL '15 minutes', ts) - to_minutes(15 * k) AS w FROM events, (SELECT unnest(range(4)) AS k)) GROUP BY w""")
def _(t):
    return t.events.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


@query("session_activity", """
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM n GROUP BY user_id, session""")
def _(t):
    return sequence.sessions(t.events.select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 1800)
