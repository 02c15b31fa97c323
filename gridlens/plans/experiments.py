"""Sampling, feature selection, evaluation, robustness, drift and privacy over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions.hashing import gaussian_sql, hash31_sql, laplace_sql, signed, signed_sql, unit_sql
from gridlens.operators import evaluate, privacy, robust, sampling, selection
from gridlens.plans.common import NUMERIC, rounded
from gridlens.plans.registry import query
from gridlens.plans.statistics import per_column

H42 = hash31_sql("event_id", 42)


# ---- sampling and splitting ---------------------------------------------------------

@query("sample_n", f"SELECT event_id, value FROM events ORDER BY {H42}, event_id LIMIT 500")
def _(t):
    return sampling.sample_rows(t.events.select("event_id", "value"), "event_id", 500)


@query("sample_fraction", f"SELECT event_id, value FROM events WHERE {unit_sql('event_id', 7)} < 0.2")
def _(t):
    return sampling.sample_fraction(t.events.select("event_id", "value"), "event_id", 0.2, 7)


@query("split_stratified", f"""
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {H42}, event_id) <= CAST(floor(count(*) OVER (PARTITION BY event_type) * 0.2) AS BIGINT) AS is_test FROM events""")
def _(t):
    return sampling.split(t.events.select("event_id", "event_type"), "event_id", 0.2, "event_type")


@query("balance_undersample", f"""
WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)
SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {hash31_sql('doc_id', 42)}, doc_id) AS rn FROM labels)
WHERE rn <= 3 * (SELECT min(n) FROM c)""")
def _(t):
    return sampling.undersample(t.labels.select("doc_id", "toxic"), "doc_id", "toxic")


@query("class_weights", """
SELECT doc_id, toxic, round(weight, 6) AS weight FROM labels JOIN (
  SELECT toxic, sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE AS weight FROM labels GROUP BY toxic) USING (toxic)""")
def _(t):
    return rounded(sampling.with_weights(t.labels.select("doc_id", "toxic"), "toxic"), ["weight"], 6)


@query("fold_assign", f"SELECT event_id, CAST({H42} % 5 AS INTEGER) AS fold FROM events")
def _(t):
    return sampling.with_fold(t.events.select("event_id"), "event_id", 5)


@query("sample_systematic", """
SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) WHERE (rn - 1) % 7 = 0""")
def _(t):
    return sampling.systematic(t.events.select("event_id", "ts", "value"), ["ts", "event_id"], 7).select("event_id", "value")


@query("sample_in_label", f"SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY {H42}, event_id LIMIT 100")
def _(t):
    return sampling.sample_rows(t.events.where("event_type = 'error'").select("event_id", "value"), "event_id", 100)


# ---- feature selection ----------------------------------------------------------------

@query("select_variance", "SELECT column_name, round(variance, 4) AS variance, variance > 0.01 AS kept FROM (" + per_column(NUMERIC, "var_pop({c}) AS variance", "lineitem") + ")")
def _(t):
    return rounded(selection.variance_filter(t.lineitem, NUMERIC), ["variance"])


CORR_COLUMNS = ["l_quantity", "l_extendedprice", "net", "l_tax", "half_tax"]
FEATURES_SQL = "f AS (SELECT *, l_extendedprice * (1 - l_discount) AS net, l_tax / 2 AS half_tax FROM lineitem)"


@query("select_corr", f"WITH {FEATURES_SQL}, c AS (" + " UNION ALL ".join(
    f"SELECT '{b}' AS column_name, abs(corr({a}, {b})) AS r FROM f" for i, a in enumerate(CORR_COLUMNS) for b in CORR_COLUMNS[i + 1:]) +
    ") SELECT column_name FROM c GROUP BY column_name HAVING max(r) > 0.9")
def _(t):
    rows = t.lineitem.withColumns({"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "half_tax": F.col("l_tax") / 2})
    return t.spark.createDataFrame([(c,) for c in selection.correlation_prune(rows, CORR_COLUMNS)], "column_name string")


@query("anova_f", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 4) AS f_value FROM (
  SELECT count(*) AS n, avg({c}) AS m, var_samp({c}) AS v, any_value(g) AS g FROM lineitem, (SELECT avg({c}) AS g FROM lineitem) GROUP BY l_returnflag)""" for c in NUMERIC))
def _(t):
    return rounded(selection.anova_f(t.lineitem, NUMERIC, "l_returnflag"), ["f_value"])


def _mi_sql(c):
    bins = " + ".join(f"CAST({c} > q[{i}] AS INTEGER)" for i in range(1, 10))
    probs = ", ".join(f"{i / 10}" for i in range(1, 10))
    return f"""SELECT '{c}' AS column_name, round(sum(n / nt * ln(n * nt / (nx * ny))), 6) + 0.0 AS mutual_information FROM (
      SELECT n::DOUBLE AS n, sum(n) OVER (PARTITION BY x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y)::DOUBLE AS ny, sum(n) OVER ()::DOUBLE AS nt FROM (
        SELECT {bins} AS x, l_returnflag AS y, count(*) AS n FROM lineitem, (SELECT quantile_cont({c}, [{probs}]) AS q FROM lineitem) GROUP BY 1, 2))"""


@query("mutual_information", " UNION ALL ".join(_mi_sql(c) for c in NUMERIC))
def _(t):
    return rounded(selection.mutual_information(t.lineitem, NUMERIC, "l_returnflag"), ["mutual_information"], 6)


@query("corr_with_target", "SELECT * FROM (" + per_column(
    NUMERIC, "round(abs(corr({c}, CAST(l_returnflag = 'R' AS INTEGER))), 6) AS abs_corr", "lineitem") + ") ORDER BY abs_corr DESC, column_name LIMIT 3")
def _(t):
    rows = t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(selection.target_correlation(rows, NUMERIC, "y", 3), ["abs_corr"], 6)


# ---- evaluation -----------------------------------------------------------------------

# A detector by rule, so that the evaluation is checked apart from any trained model.
TRUTH_SQL = "s AS (SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS truth, CAST(value > 80 AS INTEGER) AS predicted, value AS score FROM events)"
KINDS = ["click", "error", "purchase", "signup", "view"]
MULTI_SQL = f"m AS (SELECT event_type AS truth, ({KINDS})[CAST(props->>'$.k' AS INTEGER) % 4 + 1] AS predicted FROM events)"


def _scored(t):
    return t.events.select("event_id", (F.col("event_type") == "error").cast("int").alias("truth"),
                           (F.col("value") > 80).cast("int").alias("predicted"), F.col("value").alias("score"))


def _multi(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(F.col("event_type").alias("truth"), F.element_at(F.array(*map(F.lit, KINDS)), F.pmod(k, F.lit(4)) + 1).alias("predicted"))


@query("eval_accuracy", f"""
WITH {TRUTH_SQL} SELECT count(*) AS n, count(*) FILTER (truth <> predicted) AS misclassified, round(avg(CAST(truth = predicted AS INTEGER)), 6) AS accuracy FROM s""")
def _(t):
    return rounded(evaluate.accuracy(_scored(t), "truth", "predicted"), ["accuracy"], 6)


@query("confusion_matrix", f"""
WITH {MULTI_SQL}, l AS (SELECT truth AS c FROM m UNION SELECT predicted FROM m)
SELECT a.c AS truth, b.c AS predicted, count(m.truth) AS n FROM l a CROSS JOIN l b LEFT JOIN m ON m.truth = a.c AND m.predicted = b.c GROUP BY a.c, b.c""")
def _(t):
    return evaluate.confusion_matrix(_multi(t), "truth", "predicted")


@query("classification_report", f"""
WITH {MULTI_SQL}, l AS (SELECT truth AS c FROM m UNION SELECT predicted FROM m),
k AS (SELECT c, count(*) FILTER (truth = c) AS support, count(*) FILTER (predicted = c) AS given, count(*) FILTER (truth = c AND predicted = c) AS hit FROM m, l GROUP BY c),
r AS (SELECT c, support, CASE WHEN given = 0 THEN 0.0::DOUBLE ELSE hit::DOUBLE / given END AS p, CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE hit::DOUBLE / support END AS r FROM k),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS f FROM r)
SELECT c AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM f
UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def _(t):
    return rounded(evaluate.classification_report(_multi(t), "truth", "predicted"), ["precision", "recall", "f1"], 6)


@query("roc_auc", f"""
WITH {TRUTH_SQL}, p AS (SELECT score, sum(truth) AS p, sum(1 - truth) AS n FROM s GROUP BY score),
r AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp FROM p)
SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, round(sum(n * (tp - p / 2.0::DOUBLE)) / (sum(p) * sum(n))::DOUBLE, 6) AS auc FROM r""")
def _(t):
    return rounded(evaluate.roc_auc(_scored(t), "truth", "score"), ["auc"], 6)


@query("roc_points", f"""
WITH {TRUTH_SQL}, p AS (SELECT score, sum(truth) AS p, sum(1 - truth) AS n FROM s GROUP BY score)
SELECT score AS threshold, round(sum(p) OVER (ORDER BY score DESC) / (sum(p) OVER ())::DOUBLE, 6) AS tpr,
  round(sum(n) OVER (ORDER BY score DESC) / (sum(n) OVER ())::DOUBLE, 6) AS fpr FROM p""")
def _(t):
    return rounded(evaluate.roc_points(_scored(t), "truth", "score").select("threshold", "tpr", "fpr"), ["tpr", "fpr"], 6)


@query("pr_curve", f"""
WITH {TRUTH_SQL}, p AS (SELECT score, sum(truth) AS p, count(*) AS n FROM s GROUP BY score),
r AS (SELECT score, sum(p) OVER w / (sum(n) OVER w)::DOUBLE AS pr, sum(p) OVER w / (sum(p) OVER ())::DOUBLE AS rc FROM p WINDOW w AS (ORDER BY score DESC))
SELECT score AS threshold, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc = 0 THEN 0.0::DOUBLE ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1 FROM r""")
def _(t):
    return rounded(evaluate.pr_points(_scored(t), "truth", "score"), ["precision", "recall", "f1"], 6)


@query("threshold_search", f"""
WITH {TRUTH_SQL},
g AS (SELECT 0 AS m, i, 5 + 35 * i::DOUBLE / 49 AS pct FROM (SELECT unnest(range(50)) AS i) UNION ALL SELECT 1, i, 5 + 35 * i::DOUBLE / 29 FROM (SELECT unnest(range(30)) AS i)),
o AS (SELECT list(score ORDER BY score) AS v, count(*) AS n, sum(truth) AS pos FROM s),
h AS (SELECT g.*, (n - 1) * (pct / 100) AS h, v, n, pos FROM g, o),
t AS (SELECT m, i, pct, n, pos, v[CAST(floor(h) AS INTEGER) + 1] + (v[least(CAST(floor(h) AS INTEGER) + 2, n)] - v[CAST(floor(h) AS INTEGER) + 1]) * (h - floor(h)) AS th FROM h),
c AS (SELECT m, i, pct, th, any_value(n) AS n, any_value(pos) AS pos, sum(truth) AS tp, count(score) AS given FROM t LEFT JOIN s ON score < th GROUP BY m, i, pct, th),
f AS (SELECT *, CASE WHEN given + pos = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (given + pos) END AS f1, tp / (pos + 1e-8::DOUBLE) - (given - tp) / (n - pos + 1e-8::DOUBLE) AS j FROM c),
w AS (SELECT *, CASE WHEN m = 0 THEN f1 ELSE 0.7::DOUBLE * f1 + 0.3::DOUBLE * j END AS val FROM f)
SELECT CASE WHEN m = 0 THEN 'f1' ELSE 'f1_j' END AS method, round(pct, 4) AS percent, round(th, 4) AS threshold, round(f1, 6) AS f1, round(j, 6) + 0.0 AS youden, round(val, 6) + 0.0 AS value,
  row_number() OVER (ORDER BY val DESC, m, i) = 1 AS chosen FROM w""")
def _(t):
    found = evaluate.threshold_search(_scored(t), "truth", "score")
    return rounded(rounded(found, ["percent", "threshold"]), ["f1", "youden", "value"], 6)


@query("vote_hard", """
SELECT event_id, CAST((value > 80) AS INTEGER) + CAST(event_type = 'error' AS INTEGER) + CAST(CAST(props->>'$.k' AS INTEGER) > 50 AS INTEGER) >= 2 AS anomaly FROM events""")
def _(t):
    from gridlens.operators.ensemble import hard_vote

    k = F.get_json_object("props", "$.k").cast("int")
    votes = [(F.col("value") > 80).cast("int"), (F.col("event_type") == "error").cast("int"), (k > 50).cast("int")]
    return t.events.select("event_id", (hard_vote(votes) == 1).alias("anomaly"))


# ---- robustness and drift ----------------------------------------------------------------

EVENT_VALUE = ["event_id", "value"]


@query("noise_gaussian", f"SELECT event_id, round(value + 0.05::DOUBLE * {gaussian_sql('event_id', 42)}, 6) + 0.0 AS value FROM events")
def _(t):
    return rounded(robust.noise_gaussian(t.events.select(*EVENT_VALUE), "event_id", ["value"]), ["value"], 6)


@query("noise_sign", f"SELECT event_id, round(greatest(least(value + 0.1::DOUBLE * {signed_sql('event_id', 42)}, 100), 0), 6) + 0.0 AS value FROM events")
def _(t):
    return rounded(robust.noise_sign(t.events.select(*EVENT_VALUE), "event_id", ["value"], 0.1, low=0.0, high=100.0), ["value"], 6)


@query("augment", f"""
WITH c AS (SELECT event_id, value, CAST(copy AS INTEGER) AS copy FROM events, (SELECT unnest(range(1, 4)) AS copy))
SELECT event_id, copy, round(value + (0.01::DOUBLE + 0.09::DOUBLE * {unit_sql('copy', 42)}) * {signed_sql('(event_id * 3 + copy)', 43)}, 6) + 0.0 AS value FROM c""")
def _(t):
    return rounded(robust.augment(t.events.select(*EVENT_VALUE), "event_id", ["value"]), ["value"], 6)


@query("corrupt_rows", f"""
WITH c AS (SELECT event_id, value, event_type, row_number() OVER (ORDER BY {H42}, event_id) <= CAST(floor((SELECT count(*) FROM events) * 0.1) AS BIGINT) AS corrupted FROM events),
d AS (SELECT event_id, coalesce(lag(value) OVER (ORDER BY {hash31_sql('event_id', 43)}, event_id),
    last_value(value) OVER (ORDER BY {hash31_sql('event_id', 43)}, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS value,
  coalesce(lag(event_type) OVER (ORDER BY {hash31_sql('event_id', 44)}, event_id),
    last_value(event_type) OVER (ORDER BY {hash31_sql('event_id', 44)}, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS event_type FROM c WHERE corrupted)
SELECT event_id, value, event_type, corrupted FROM c WHERE NOT corrupted UNION ALL SELECT event_id, value, event_type, true FROM d""")
def _(t):
    return robust.corrupt_rows(t.events.select("event_id", "value", "event_type"), "event_id", ["value", "event_type"])


@query("time_jitter", f"SELECT event_id, ts + to_seconds({H42} % 20 - 10) AS ts FROM events")
def _(t):
    return robust.jitter_time(t.events.select("event_id", "ts"), "event_id", "ts")


def _flip_sql(rate):
    return f"""
WITH r AS (SELECT event_id, event_type, row_number() OVER (ORDER BY {H42}, event_id) <= CAST(floor((SELECT count(*) FROM events) * {rate}) AS BIGINT) AS is_flipped,
  {hash31_sql('event_id', 43)} % 4 AS p, dense_rank() OVER (ORDER BY event_type) - 1 AS own FROM events)
SELECT event_id, event_type, CASE WHEN is_flipped THEN ({KINDS})[CAST(p + CAST(p >= own AS INTEGER) + 1 AS INTEGER)] ELSE event_type END AS flipped_label, is_flipped FROM r"""


@query("label_flip", _flip_sql(0.25))
def _(t):
    return robust.flip_labels(t.events.select("event_id", "event_type"), "event_id", "event_type", 0.25)


@query("replay_tag", f"SELECT event_id, CASE WHEN {unit_sql('event_id', 42)} < 0.01 THEN 'Replay' ELSE 'Normal' END AS attack_type FROM events")
def _(t):
    return robust.tag_replay(t.events.select("event_id"), "event_id")


IMPORTANCE = [0.04 if j % 3 == 0 else 0.005 for j in range(64)]


@query("perturb_step", f"""
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(range(64)) AS BIGINT) AS j FROM embeddings),
p AS (SELECT vec_id, j, x, greatest(0, least(1, x + {signed_sql('(vec_id % 2147483647 * 1000 + 0) * 4096 + j', 42)} * 0.1 * 10.0 * CASE WHEN j % 3 = 0 THEN 0.04 ELSE 0.005 END)) AS y FROM e)
SELECT vec_id, round(sum(y), 4) AS total, round(sqrt(sum((y - x) * (y - x))), 4) AS l2 FROM p GROUP BY vec_id""")
def _(t):
    moved = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), robust.perturb_step("embedding", "vec_id", IMPORTANCE, 0.1).alias("y"))
    return _moved_summary(moved)


def _moved_summary(moved):
    add = lambda a, b: a + b
    square = F.zip_with("x", "y", lambda a, b: (b - a) * (b - a))
    return rounded(moved.select("vec_id", F.aggregate("y", F.lit(0.0), add).alias("total"), F.sqrt(F.aggregate(square, F.lit(0.0), add)).alias("l2")), ["total", "l2"])


@query("perturb_projected")
def _(t):
    moved = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"),
                                robust.perturb_projected("embedding", "vec_id", IMPORTANCE, 0.3).alias("y"))
    return _moved_summary(moved)


@query("diff_summary", f"""
WITH d AS (SELECT 0.1::DOUBLE * {signed_sql('event_id', 42)} AS a, 0.05::DOUBLE * {gaussian_sql('event_id', 7)} AS b FROM events)
SELECT 'sign' AS column_name, round(avg(a), 6) + 0.0 AS mean_diff, round(max(a), 6) AS max_diff, round(sqrt(sum(a * a)), 6) AS l2_norm FROM d
UNION ALL SELECT 'gaussian', round(avg(b), 6) + 0.0, round(max(b), 6), round(sqrt(sum(b * b)), 6) FROM d""")
def _(t):
    base = t.events.select("event_id", "value", F.col("value").alias("sign"), F.col("value").alias("gaussian"))
    moved = robust.noise_gaussian(robust.noise_sign(base, "event_id", ["sign"]), "event_id", ["gaussian"], seed=7)
    return rounded(robust.diff_summary(moved, {"sign": ("value", "sign"), "gaussian": ("value", "gaussian")}), ["mean_diff", "max_diff", "l2_norm"], 6)


@query("feature_shift", f"""
WITH e AS (SELECT event_id, value, CAST(props->>'$.k' AS DOUBLE) AS k, event_type = 'error' AS attack FROM events),
b AS (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM e WHERE NOT attack), a AS (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM e WHERE attack)
SELECT 'value' AS column_name, (SELECT round(avg(abs(greatest(least(value + 0.1::DOUBLE * {signed_sql('event_id', 42)}, 300), 0) - value)), 6) FROM b) AS perturbed_shift,
  (SELECT round(avg(abs(a.value - b.value)), 6) FROM a JOIN b USING (r)) AS attack_shift
UNION ALL SELECT 'k', (SELECT round(avg(abs(greatest(least(k + 0.1::DOUBLE * {signed_sql('event_id', 42)}, 300), 0) - k)), 6) FROM b),
  (SELECT round(avg(abs(a.k - b.k)), 6) FROM a JOIN b USING (r))""")
def _(t):
    rows = t.events.select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), "event_type")
    moved = {c: F.greatest(F.lit(0.0), F.least(F.lit(300.0), F.col(c) + 0.1 * signed("event_id", 42))) for c in ("value", "k")}
    return rounded(robust.feature_shift(rows, ["value", "k"], "event_id", F.col("event_type") == "error", moved), ["perturbed_shift", "attack_shift"], 6)


def _psi_sql(c):
    bins = " + ".join(f"CAST({c} > q[{i}] AS INTEGER)" for i in range(1, 10))
    probs = ", ".join(f"{i / 10}" for i in range(1, 10))
    return f"""SELECT '{c}' AS column_name, round(sum((r - e) * ln(r / e)), 6) + 0.0 AS psi FROM (
      SELECT greatest(count(*) FILTER (recent)::DOUBLE / sum(count(*) FILTER (recent)) OVER (), 1e-4) AS r,
        greatest(count(*) FILTER (NOT recent)::DOUBLE / sum(count(*) FILTER (NOT recent)) OVER (), 1e-4) AS e
      FROM d, (SELECT quantile_cont({c}, [{probs}]) AS q FROM d WHERE NOT recent) GROUP BY {bins})"""


@query("drift_psi", """WITH d AS (SELECT value, CAST(props->>'$.k' AS DOUBLE) AS k, ts >= TIMESTAMP '2024-01-16' AS recent FROM events) """ + _psi_sql("value") + " UNION ALL " + _psi_sql("k"))
def _(t):
    rows = t.events.select("value", F.get_json_object("props", "$.k").cast("double").alias("k"), "ts")
    return rounded(robust.stability_index(rows, ["value", "k"], F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")), ["psi"], 6)


# ---- privacy and comparison ------------------------------------------------------------------

@query("dp_laplace", f"""
SELECT event_id, round(value + {laplace_sql('event_id', 42, '(SELECT (max(value) - min(value)) / 0.5 FROM events)')}, 4) + 0.0 AS value FROM events""")
def _(t):
    return rounded(privacy.laplace_noise(t.events.select(*EVENT_VALUE), "event_id", ["value"], 0.5), ["value"])


@query("mask_numeric", f"SELECT event_id, round((value * 617 * (0.999::DOUBLE + 0.002::DOUBLE * {unit_sql('event_id', 42)})) % 1000000007.0::DOUBLE, 4) AS value FROM events")
def _(t):
    return rounded(privacy.mask_numeric(t.events.select(*EVENT_VALUE), "event_id", ["value"]), ["value"])


@query("entropy_redundancy", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, round(h, 4) AS entropy, round(1 - h / log2(d), 4) + 0.0 AS redundancy FROM (
  SELECT -sum(CASE WHEN {c} > 0 THEN {c} / s * log2({c} / s) END) AS h, count(DISTINCT {c}) AS d FROM lineitem, (SELECT sum({c}) AS s FROM lineitem))""" for c in NUMERIC))
def _(t):
    return rounded(privacy.entropy_redundancy(t.lineitem, NUMERIC), ["entropy", "redundancy"])


# The transformed twin of each column: a masked copy, and a copy with relative noise.
TWIN_SQL = f"""tw AS (SELECT event_id, value, CAST(props->>'$.k' AS DOUBLE) AS k,
  (value * 617 * (0.999::DOUBLE + 0.002::DOUBLE * {unit_sql('event_id', 42)})) % 1000000007.0::DOUBLE AS value_t,
  CAST(props->>'$.k' AS DOUBLE) * (1 + 0.5::DOUBLE * {unit_sql('event_id', 9)}) AS k_t FROM events)"""
TWINS = {"value": ("value", "value_t"), "k": ("k", "k_t")}


def _twins(t):
    from gridlens.functions.hashing import unit

    k = F.get_json_object("props", "$.k").cast("double")
    base = t.events.select("event_id", "value", k.alias("k"), F.col("value").alias("value_t"), (k * (1 + 0.5 * unit("event_id", 9))).alias("k_t"))
    return privacy.mask_numeric(base, "event_id", ["value_t"])


@query("kl_divergence", f"WITH {TWIN_SQL} " + " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, round(sum(p / sp * ln((p / sp) / (q / sq))), 6) + 0.0 AS kl FROM (
  SELECT p, q, sum(p) OVER () AS sp, sum(q) OVER () AS sq FROM (
    SELECT greatest(least({c} / s, 1), 1e-10::DOUBLE) AS p, greatest(least({c}_t / st, 1), 1e-10::DOUBLE) AS q FROM tw, (SELECT sum({c}) AS s, sum({c}_t) AS st FROM tw)))""" for c in TWINS))
def _(t):
    return rounded(privacy.kl_divergence(_twins(t), TWINS), ["kl"], 6)


@query("cosine_columns", f"WITH {TWIN_SQL}, c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, sum({c} * {c}_t) / sqrt(sum({c} * {c}) * sum({c}_t * {c}_t)) AS s FROM tw" for c in TWINS) + """)
SELECT column_name, round(s, 6) AS similarity, round(1 - s, 6) + 0.0 AS distance, round(greatest(-2, least(3, (s - avg(s) OVER ()) / stddev_pop(s) OVER ())), 4) + 0.0 AS scaled FROM c""")
def _(t):
    return rounded(rounded(privacy.cosine_columns(_twins(t), TWINS), ["similarity", "distance"], 6), ["scaled"])


STATS_SQL = f"WITH {TWIN_SQL}, st AS (" + " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, avg({c}) AS mean_before, stddev_samp({c}) AS std_before, min({c}) AS min_before, max({c}) AS max_before,
  avg({c}_t) AS mean_after, stddev_samp({c}_t) AS std_after, min({c}_t) AS min_after, max({c}_t) AS max_after FROM tw""" for c in TWINS) + ")"
STATS = [f"{s}_{w}" for w in ("before", "after") for s in ("mean", "std", "min", "max")]


@query("before_after_stats", STATS_SQL + " SELECT column_name, " + ", ".join(f"round({c}, 4) AS {c}" for c in STATS) + " FROM st")
def _(t):
    return rounded(privacy.before_after_stats(_twins(t), TWINS), STATS)


@query("mean_shift_bands", STATS_SQL + """, d AS (SELECT column_name, abs(mean_after - mean_before) AS s FROM st),
q AS (SELECT quantile_cont(s, 0.1) AS p10, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.9) AS p90 FROM d)
SELECT column_name, round(s, 4) AS mean_shift, CASE WHEN s <= p10 THEN 'low' WHEN s <= p50 THEN 'mid' WHEN s <= p90 THEN 'high' ELSE 'extreme' END AS band,
  round(p10, 4) AS p10, round(p50, 4) AS p50, round(p90, 4) AS p90 FROM d, q""")
def _(t):
    return rounded(privacy.mean_shift_bands(privacy.before_after_stats(_twins(t), TWINS)), ["mean_shift", "p10", "p50", "p90"])


@query("correlation_change", f"WITH {TWIN_SQL} SELECT 'value' AS column_a, 'k' AS column_b, round(corr(value, k), 6) + 0.0 AS corr_before, round(corr(value_t, k_t), 6) + 0.0 AS corr_after FROM tw")
def _(t):
    return rounded(privacy.correlation_change(_twins(t), TWINS), ["corr_before", "corr_after"], 6)
