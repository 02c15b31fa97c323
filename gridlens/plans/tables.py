"""Sources, sinks, predicates, rules, cleaning and encoding over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions import names
from gridlens.functions.scalar import folder_label, parse_log_line, severity_band, to_number
from gridlens.operators import clean, encode, rules
from gridlens.operators.profile import binary_columns as find_binary
from gridlens.plans.common import (
    ALERTS_SQL, NUMERIC, PACKETS_SQL, SOURCE_IP_SQL, event_alerts, packets, rounded, source_ip,
)
from gridlens.plans.registry import query
from gridlens.session import scratch
from gridlens.sources import tabular


# ---- sources and sinks -------------------------------------------------------

@query("src_csv_roundtrip", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    path = scratch(t.spark, "csv")
    tabular.write_csv(rows, path)
    return tabular.read_csv(t.spark, path, rows.schema)


@query("src_folder_union", "SELECT event_id, user_id, value, event_type AS attack_type FROM events")
def _(t):
    """Two groups of files: another order of columns, and one column more."""
    path = scratch(t.spark, "folders")
    even = F.col("event_id") % 2 == 0
    tabular.write_csv(t.events.where(even).select("event_id", "user_id", "value", "event_type"), f"{path}/a", partition_by=["event_type"])
    tabular.write_csv(t.events.where(~even).select("value", "event_id", F.lit("x").alias("note"), "user_id", "event_type"), f"{path}/b", partition_by=["event_type"])
    good, _ = tabular.read_folder(t.spark, path, "event_id bigint, user_id bigint, value double")
    return good.select("event_id", "user_id", "value", F.regexp_extract("source_path", r"event_type=([^/]+)/", 1).alias("attack_type"))


@query("src_path_label", """
SELECT page_id, array_to_string(list_slice(string_split(list_extract(string_split(url, '/'), -1), '.'), 2, 1000000), '.') AS label
FROM pages""")
def _(t):
    return t.pages.select("page_id", folder_label("url", skip=1, depth=1, sep=".").alias("label"))


@query("scan_pruned", "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_discount >= 0.05 AND l_shipdate >= TIMESTAMP '1995-01-01'")
def _(t):
    cut = F.lit("1995-01-01").cast("timestamp_ntz")
    return t.lineitem.where((F.col("l_discount") >= 0.05) & (F.col("l_shipdate") >= cut)).select("l_orderkey", "l_quantity", "l_returnflag")


@query("scan_limit", "SELECT event_id, ts, value FROM events ORDER BY event_id LIMIT 1000")
def _(t):
    return t.events.select("event_id", "ts", "value").orderBy("event_id").limit(1000)


@query("profile_json", """
SELECT event_type, json_extract_string(j, '$.n')::BIGINT AS n, round(json_extract_string(j, '$.mean')::DOUBLE, 4) AS mean FROM (
  SELECT event_type, to_json({'n': count(*), 'mean': avg(value)}) AS j FROM events GROUP BY event_type)""")
def _(t):
    profile = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    path = scratch(t.spark, "json")
    tabular.write_json(profile, path)
    back = t.spark.read.schema("event_type string, n bigint, mean double").json(path)
    return rounded(back, ["mean"])


@query("export_selected", """
SELECT event_id, user_id, CASE WHEN value > 70 THEN 'critical' ELSE 'normal' END AS band, event_type = 'error' AS is_attack
FROM events WHERE value > 50""")
def _(t):
    rows = t.events.where("value > 50").select(
        "event_id", "user_id", severity_band("value", "flag").alias("band"), (F.col("event_type") == "error").alias("is_attack")
    )
    path = scratch(t.spark, "export")
    tabular.write_csv(rows, path)
    return tabular.read_csv(t.spark, path, rows.schema)


# ---- predicates, labels and rules ---------------------------------------------

@query("binary_columns", """
SELECT 'l_linestatus' AS column_name WHERE (SELECT count(DISTINCT l_linestatus) FROM lineitem) = 2
UNION ALL SELECT 'l_returnflag' WHERE (SELECT count(DISTINCT l_returnflag) FROM lineitem) = 2
UNION ALL SELECT 'l_linenumber' WHERE (SELECT count(DISTINCT l_linenumber) FROM lineitem) = 2
UNION ALL SELECT 'l_discount' WHERE (SELECT count(DISTINCT l_discount) FROM lineitem) = 2""")
def _(t):
    found = find_binary(t.lineitem, ["l_linestatus", "l_returnflag", "l_linenumber", "l_discount"])
    return t.spark.createDataFrame([(c,) for c in found], "column_name string")


@query("align_features", """
SELECT l_orderkey, l_linenumber, coalesce(l_tax, 0.0::DOUBLE) AS l_tax, 0.0::DOUBLE AS burst_ratio, coalesce(l_quantity, 0.0::DOUBLE) AS l_quantity FROM lineitem""")
def _(t):
    return names.align(t.lineitem, ["l_tax", "burst_ratio", "l_quantity"], keep=("l_orderkey", "l_linenumber"))


@query("dropna_rows", """
SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE value END AS value FROM events WHERE value <= 100""")
def _(t):
    holed = t.events.select("event_id", F.when(F.col("value") <= 100, F.col("value")).alias("value"))
    return clean.drop_null_rows(holed, ["value"])


@query("label_keyword", """
SELECT event_id, CASE WHEN regexp_matches(lower(event_type), 'attack|malicious|threat|dos|mitm|breach|intrusion|exploit|anomaly|error') THEN 1
  WHEN regexp_matches(lower(event_type), 'normal|benign|legitimate|view|click') THEN 0 ELSE 1 END AS label FROM events""")
def _(t):
    return t.events.select("event_id", rules.keyword_label("event_type", (*rules.ATTACK_WORDS, "anomaly", "error"), (*rules.NORMAL_WORDS, "view", "click")).alias("label"))


@query("label_binary", "SELECT event_id, CASE WHEN upper(trim(event_type)) <> 'VIEW' THEN 1 ELSE 0 END AS label FROM events")
def _(t):
    return t.events.select("event_id", rules.binary_label("event_type", "view").alias("label"))


@query("firewall_check", f"""
WITH {PACKETS_SQL}, black AS (SELECT src FROM packets WHERE event_type = 'error' GROUP BY src HAVING sum(value) > 4000),
ports AS (SELECT 2404 AS port)
SELECT packet_id, src, dport, (src NOT IN (SELECT src FROM black)) AND dport IN (SELECT port FROM ports) AS allowed FROM packets""")
def _(t):
    p = packets(t.events)
    black = p.where("event_type = 'error'").groupBy("src").agg(F.sum("value").alias("s")).where("s > 4000").select(F.col("src").alias("ip"))
    ports = t.spark.createDataFrame([(2404,)], "port int")
    return rules.firewall_check(p.select("packet_id", "src", "dport"), "src", "dport", black, ports)


# A rule table with overlapping prefixes, a host rule and an inactive rule.
RULES = [
    (1, "10.0.0.0/8", "ALLOW", True), (2, "10.1.0.0/16", "INSPECT", True), (3, "10.2.0.0/16", "BLOCK", True),
    (4, "10.2.6.0/24", "ALLOW", True), (5, "10.1.5.7/32", "BLOCK", True), (6, "10.3.0.0/16", "BLOCK", False),
    (7, "10.2.0.0/16", "ALLOW", True), (8, "192.168.0.0/16", "BLOCK", True),
]


def _ip_number_sql(ip):
    return "(" + " + ".join(f"CAST(split_part({ip}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)) + ")"


@query("cidr_rules", f"""
WITH rules(rule_id, src_cidr, action, active) AS (VALUES {', '.join(f"({a}, '{b}', '{c}', {str(d).lower()})" for a, b, c, d in RULES)}),
nets AS (SELECT rule_id, action, CAST(split_part(src_cidr, '/', 2) AS INTEGER) AS bits,
  {_ip_number_sql("split_part(src_cidr, '/', 1)")} AS net
  FROM rules WHERE active),
src AS (SELECT event_id, {SOURCE_IP_SQL} AS ip,
  {_ip_number_sql(SOURCE_IP_SQL)} AS n FROM events)
SELECT event_id, ip, rule_id, coalesce(action, 'ALLOW') AS action FROM (
  SELECT event_id, ip, rule_id, action, row_number() OVER (PARTITION BY event_id ORDER BY bits DESC, rule_id) AS rn
  FROM src LEFT JOIN nets ON (n >> (32 - bits)) = (net >> (32 - bits))) WHERE rn = 1""")
def _(t):
    table = t.spark.createDataFrame(RULES, "rule_id int, src_cidr string, action string, active boolean")
    return rules.cidr_action(t.events.select("event_id", source_ip("user_id").alias("ip")), "ip", table)


@query("blocked_flag", """
SELECT event_id, NOT (lower(trim(event_type)) IN ('normal', 'benign', 'legitimate', 'none', 'clean', 'safe')) AS blocked FROM events""")
def _(t):
    return t.events.select("event_id", rules.blocked_flag("event_type").alias("blocked"))


@query("offending_sources", "SELECT DISTINCT user_id FROM events WHERE lower(trim(event_type)) <> 'view'")
def _(t):
    return rules.offending_sources(t.events, "user_id", "event_type", "view")


@query("severity_band", f"""
WITH {ALERTS_SQL} SELECT event_id, CASE WHEN confidence > 0.85 THEN 'HIGH' ELSE 'MEDIUM' END AS alert_band,
  CASE WHEN value > 85 THEN 'high' WHEN value > 70 THEN 'medium' ELSE 'low' END AS percent_band,
  CASE WHEN value > 70 THEN 'critical' ELSE 'normal' END AS flag_band FROM alerts""")
def _(t):
    return event_alerts(t.events).select(
        "event_id", severity_band("confidence").alias("alert_band"), severity_band("value", "percent").alias("percent_band"),
        severity_band("value", "flag").alias("flag_band"),
    )


@query("protocol_violations", """
WITH f AS (SELECT event_id, CAST(floor(value * 3) AS INTEGER) AS len, CAST(event_id % 4 AS INTEGER) AS c1, CAST(user_id % 4 AS INTEGER) AS c2 FROM events),
v AS (SELECT event_id, concat_ws(',', CASE WHEN len > 253 THEN 'apdu_length' END, CASE WHEN c1 NOT IN (0, 1, 3) THEN 'control_1' END,
  CASE WHEN c2 NOT IN (0, 1, 3) THEN 'control_2' END) AS violations FROM f)
SELECT event_id, violations FROM v WHERE violations <> ''""")
def _(t):
    frames = t.events.select(
        "event_id", F.floor(F.col("value") * 3).cast("int").alias("len"),
        F.pmod("event_id", F.lit(4)).cast("int").alias("c1"), F.pmod("user_id", F.lit(4)).cast("int").alias("c2"),
    )
    found = frames.select("event_id", rules.frame_violations("len", ["c1", "c2"]).alias("v")).where(F.size("v") > 0)
    return found.select("event_id", F.array_join("v", ",").alias("violations"))


@query("vector_validate", """
SELECT vec_id, CASE WHEN embedding IS NULL OR len(embedding) = 0 THEN 'empty' WHEN len(embedding) <> 64 THEN 'width'
  WHEN label >= 8 THEN 'unknown_model' END AS reject FROM embeddings""")
def _(t):
    model = F.concat(F.lit("m"), "label")
    return t.embeddings.select(
        "vec_id", rules.vector_error("embedding", 64, model, tuple(f"m{i}" for i in range(8))).alias("reject")
    )


@query("unpivot_long", """
UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem)
ON l_quantity, l_extendedprice, l_discount INTO NAME feature VALUE val""")
def _(t):
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount"], "feature", "val")


# ---- cleaning ------------------------------------------------------------------

@query("clean_inf", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE value END AS rate FROM events""")
def _(t):
    dirty = t.events.select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("inf")))
                            .when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("rate"))
    return clean.clean_infinite(dirty, ["rate"])


@query("coerce_numeric", """
SELECT event_id, TRY_CAST(props->>'$.k' AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad,
  coalesce(TRY_CAST(event_type AS DOUBLE), 0.0::DOUBLE) AS bad_zero FROM events""")
def _(t):
    return t.events.select(
        "event_id", to_number(F.get_json_object("props", "$.k")).alias("k"), to_number("event_type").alias("bad"),
        to_number("event_type", 0).alias("bad_zero"),
    )


HOLED_SQL = "holed AS (SELECT event_id, event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events)"


def _holed(t):
    return t.events.select("event_id", "event_type", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"))


@query("impute_mean", f"WITH {HOLED_SQL} SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM holed)), 4) AS value FROM holed")
def _(t):
    return rounded(clean.impute(_holed(t).drop("event_type"), ["value"], "mean"), ["value"])


@query("impute_median", f"WITH {HOLED_SQL} SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM holed)), 4) AS value FROM holed")
def _(t):
    return rounded(clean.impute(_holed(t).drop("event_type"), ["value"], "median"), ["value"])


@query("impute_mode", """
WITH holed AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS event_type FROM events)
SELECT event_id, coalesce(event_type, (SELECT event_type FROM holed WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type FROM holed""")
def _(t):
    holed = t.events.select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("event_type"))
    return clean.impute(holed, ["event_type"], "mode")


@query("impute_adaptive", f"""
WITH {HOLED_SQL}, s AS (SELECT CASE WHEN abs(skewness(value)) > 1 THEN quantile_cont(value, 0.5) ELSE avg(value) END AS f FROM holed)
SELECT event_id, round(coalesce(value, (SELECT f FROM s)), 4) AS value FROM holed""")
def _(t):
    return rounded(clean.impute(_holed(t).drop("event_type"), ["value"], "adaptive"), ["value"])


@query("clip_fixed", "SELECT event_id, greatest(least(value * 50000, 1e6::DOUBLE), -1e6::DOUBLE) AS value FROM events")
def _(t):
    return clean.clip_fixed(t.events.select("event_id", (F.col("value") * 50000).alias("value")), ["value"])


FENCE_SQL = """f AS (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
  quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {t})"""


@query("iqr_clip", f"""
WITH {FENCE_SQL.format(c='value', t='events')}
SELECT event_id, round(greatest(least(value, (SELECT hi FROM f)), (SELECT lo FROM f)), 4) AS value FROM events""")
def _(t):
    return rounded(clean.iqr_clip(t.events.select("event_id", "value"), ["value"]), ["value"])


@query("iqr_filter", f"""
WITH {FENCE_SQL.format(c='value', t='events')} SELECT event_id, value FROM events, f WHERE value BETWEEN lo AND hi""")
def _(t):
    return clean.iqr_filter(t.events.select("event_id", "value"), ["value"])


@query("downcast", """
SELECT CAST(l_linenumber AS TINYINT) AS l_linenumber, CAST(l_suppkey AS SMALLINT) AS l_suppkey, CAST(l_quantity AS FLOAT) AS l_quantity,
  l_extendedprice FROM lineitem""")
def _(t):
    # The types follow from the data: the stated SQL is what the ranges of the check tables give.
    return clean.downcast(t.lineitem.select("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"),
                          ["l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"])


# ---- encoding and scaling --------------------------------------------------------

@query("label_encode", "SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def _(t):
    return encode.label_encode(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "code")


@query("factorize", """
WITH s AS (SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type)
SELECT event_id, event_type, code FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY first_id) - 1 AS code FROM s) USING (event_type)""")
def _(t):
    return encode.factorize(t.events.select("event_id", "event_type"), "event_type", "event_id", "code")


@query("category_codes", """
WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang FROM documents),
v AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM d WHERE lang IS NOT NULL))
SELECT doc_id, d.lang, coalesce(code, -1) AS code FROM d LEFT JOIN v ON d.lang = v.lang""")
def _(t):
    docs = t.documents.select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"))
    return encode.category_codes(docs, "lang", "code")


@query("one_hot", """
SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_returnflag = 'A' AS INTEGER) AS flag_A, CAST(l_returnflag = 'N' AS INTEGER) AS flag_N,
  CAST(l_returnflag = 'R' AS INTEGER) AS flag_R FROM lineitem""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    return encode.one_hot(rows, "l_returnflag", encode.categories(rows, "l_returnflag"), prefix="flag")


def _scaled(t, method):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *NUMERIC)
    return rounded(encode.scale(rows, encode.scale_params(rows, NUMERIC, method)), NUMERIC)


def _scaled_sql(shift, spread):
    parts = ", ".join(
        f"round(({c} - (SELECT {shift.format(c=c)} FROM lineitem)) / (SELECT {spread.format(c=c)} FROM lineitem), 4) + 0.0 AS {c}" for c in NUMERIC
    )
    return f"SELECT l_orderkey, l_linenumber, {parts} FROM lineitem"


@query("minmax_scale", _scaled_sql("min({c})", "max({c}) - min({c})"))
def _(t):
    return _scaled(t, "minmax")


@query("zscore", _scaled_sql("avg({c})", "stddev_pop({c})"))
def _(t):
    return _scaled(t, "zscore")


@query("robust_scale", _scaled_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def _(t):
    return _scaled(t, "robust")


@query("hash_categorical", "SELECT c_custkey, sha256(c_mktsegment) AS c_mktsegment FROM customer")
def _(t):
    return encode.hash_text(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


# ---- scalar functions --------------------------------------------------------------

@query("log_parse", f"""
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE date_trunc('second', ts) END AS ts,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'Decoy ' || event_type END AS message,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE {SOURCE_IP_SQL} END AS ip FROM events""")
def _(t):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("broken "), stamp)).otherwise(
        F.concat(F.lit("["), stamp, F.lit("] Decoy "), "event_type", F.lit(" from "), source_ip("user_id"))
    )
    lines = t.events.select("event_id", line.alias("line"))
    return lines.select("event_id", *[c.alias(n) for n, c in parse_log_line("line").items()])


@query("json_extract", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, to_json({'source': user_id, 'kind': event_type}) AS alert FROM events")
def _(t):
    return t.events.select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.to_json(F.struct(F.col("user_id").alias("source"), F.col("event_type").alias("kind"))).alias("alert"),
    )
