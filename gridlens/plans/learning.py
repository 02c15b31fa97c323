"""Supervised models, anomaly detectors and neighbour joins over the given tables.

Trained models have no SQL twin, so most queries here are checked by tests of their operators;
those whose answer is defined by the data alone carry SQL.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gridlens.operators import ablation, anomaly, density, models, neighbors, novelty, robust, sampling, selection, vector_index
from gridlens.plans.common import rounded, vector_columns
from gridlens.plans.registry import query
from gridlens.session import cut_lineage, scratch, spread

WIDTH = 64


def _parts(t, binary=False):
    """(train, test) vectors with stratified 20 % test rows."""
    target = (F.col("label") < 5).cast("int") if binary else F.col("label")
    rows = t.embeddings.select("vec_id", target.alias("y"), "embedding")
    marked = sampling.split(rows, "vec_id", 0.2, "y")
    # Training reads its rows many times, so they are written once.
    vectors = cut_lineage(models.as_vectors(marked, "embedding", "y", keep=("vec_id", "is_test")))
    return vectors.where("not is_test").drop("is_test"), vectors.where("is_test").drop("is_test")


def _predictions(model, test):
    return model.transform(test).select("vec_id", F.col("label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("predicted"))


def _fit_and_score(t, kind, binary=False, **params):
    train, test = _parts(t, binary=binary)
    return _predictions(models.classifier(kind, 2 if binary else 10, WIDTH, **params).fit(train), test)


@query("dt_predict")
def _(t):
    return _fit_and_score(t, "tree")


@query("rf_predict")
def _(t):
    return _fit_and_score(t, "forest", numTrees=20, maxDepth=8)


@query("gbt_predict")
def _(t):
    return _fit_and_score(t, "histogram", maxIter=20, maxDepth=4, stepSize=0.2)


REGIMES_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)
SELECT vec_id, 2 * (CAST(a > -0.12 AS INTEGER) + CAST(a > -0.03 AS INTEGER) + CAST(a > 0.05 AS INTEGER) + CAST(a > 0.13 AS INTEGER)) + CAST(b > 0 AS INTEGER) AS truth,
  md5(CAST(vec_id AS VARCHAR)) < '33' AS held_out, TRUE AS whole, TRUE AS floor_met FROM v WHERE a IS NOT NULL AND b IS NOT NULL"""


def _regimes(t):
    """Vectors with one of ten classes that follow from their first two elements; a fifth, by the id's hash, is held out."""
    a, b = (F.col("embedding")[i].cast("double") for i in (0, 1))
    band = sum(((a > c).cast("int") for c in (-0.03, 0.05, 0.13)), (a > -0.12).cast("int"))
    rows = t.embeddings.select("vec_id", "embedding", (2 * band + (b > 0).cast("int")).alias("truth"),
                               (F.md5(F.col("vec_id").cast("string")) < "33").alias("held_out")).where("truth is not null")
    return spread(cut_lineage(models.as_vectors(rows, "embedding", "truth", keep=("vec_id", "held_out"))))


def _above_floor(scored, floor):
    """Per row its class, whether its probabilities sum to one, and whether the held-out rows reach the accuracy ``floor``."""
    total = F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda s, v: s + v)
    scored = cut_lineage(scored.select("vec_id", F.col("label").cast("int").alias("truth"), "held_out", (F.abs(total - 1) < 1e-9).alias("whole"), "prediction"))
    reached = scored.where("held_out").agg((F.avg((F.col("prediction") == F.col("truth")).cast("double")) >= floor).alias("floor_met"))
    return scored.drop("prediction").crossJoin(F.broadcast(reached))  # one row


@query("gbt_regimes", REGIMES_SQL)
def _(t):
    rows = _regimes(t)
    model = models.classifier("histogram", 10, maxIter=15, maxDepth=4, stepSize=0.3).fit(rows.where("not held_out"))
    return _above_floor(model.transform(rows), 0.8)


@query("adaboost_predict")
def _(t):
    train, test = _parts(t)
    fitted = models.fit_adaboost(train, 10, rounds=5, depth=2)
    scored = models.adaboost_predict(test, fitted, 10)
    return scored.select("vec_id", F.col("label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("predicted"))


@query("mlp_predict")
def _(t):
    return _fit_and_score(t, "mlp", maxIter=30)


@query("svm_predict")
def _(t):
    return _fit_and_score(t, "svm", binary=True, maxIter=20)


@query("svm_rbf_predict")
def _(t):
    train, test = (models.kernel_vectors(p, "features", WIDTH) for p in _parts(t, binary=True))
    return _predictions(models.classifier("svm", 2, maxIter=20).fit(train), test)


@query("vote_soft")
def _(t):
    train, test = _parts(t)
    fitted = {"tree": models.classifier("tree", 10).fit(train), "logistic": models.classifier("logistic", 10, maxIter=20).fit(train)}
    voted = models.soft_vote(fitted, test)
    return voted.select("vec_id", F.col("label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("predicted"))


@query("stacking")
def _(t):
    train, test = _parts(t)
    bases = {"tree": models.classifier("tree", 10, maxDepth=4), "logistic": models.classifier("logistic", 10, maxIter=8)}
    full, meta, _ = models.stack(bases, train, "vec_id", 10, folds=3)
    return _predictions_of(models.stack_predict(full, meta, test, "vec_id"))


def _predictions_of(scored):
    return scored.select("vec_id", F.col("label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("predicted"))


@query("stacking_subset")
def _(t):
    # Meta features are made on a 20 % subset only, as a cheaper form of stacking.
    train, test = _parts(t)
    subset = sampling.sample_rows(train, "vec_id", max(1, int(train.count() * 0.2)))
    bases = {"tree": models.classifier("tree", 10, maxDepth=4), "logistic": models.classifier("logistic", 10, maxIter=8)}
    full, meta, _ = models.stack(bases, subset, "vec_id", 10, folds=2)
    return _predictions_of(models.stack_predict(full, meta, test, "vec_id"))


@query("grid_search")
def _(t):
    train, _ = _parts(t)
    _, table = models.grid_search("tree", train, "vec_id", 10, {"maxDepth": [4, 8], "impurity": ["gini", "entropy"]}, folds=3)
    return t.spark.createDataFrame([(p["maxDepth"], p["impurity"], s) for p, s in table], "max_depth int, impurity string, accuracy double")


@query("cross_validation")
def _(t):
    train, _ = _parts(t)
    mean, spread = models.cross_validate("tree", train, "vec_id", 10, folds=5)
    return t.spark.createDataFrame([("tree", mean, spread)], "model string, accuracy double, two_std double")


@query("model_comparison")
def _(t):
    train, test = _parts(t)
    fitted = {k: models.classifier(k, 10, WIDTH, **p).fit(train) for k, p in (
        ("tree", {}), ("forest", {"numTrees": 20, "maxDepth": 8}), ("logistic", {"maxIter": 20}))}
    return t.spark.createDataFrame(models.compare(fitted, test), "model string, accuracy double, f1 double")


@query("batch_score")
def _(t):
    names = [f"f{i}" for i in range(8)]
    rows = vector_columns(t.embeddings, 8)
    path = scratch(t.spark, "model")
    model, features, _ = models.load_or_train(
        path, t.spark, lambda: (models.fit_pipeline("tree", rows, names, "label", 10), names, [str(c) for c in range(10)]))
    holed = rows.withColumn("f0", F.when(F.col("vec_id") % 10 != 0, F.col("f0")))
    return models.batch_score(model, holed, features, "vec_id")


@query("feature_importance")
def _(t):
    train, _ = _parts(t)
    model = models.classifier("forest", 10, numTrees=20, maxDepth=8).fit(train)
    return t.spark.createDataFrame(models.importance_table(model, [f"f{i}" for i in range(WIDTH)], 15), "feature string, importance double")


@query("select_importance")
def _(t):
    train, _ = _parts(t)
    scores = dict(models.importance_table(models.classifier("forest", 10, numTrees=20, maxDepth=8).fit(train), [f"f{i}" for i in range(WIDTH)], WIDTH))
    chosen = selection.above_percentile(scores, 25)
    columns = vector_columns(t.embeddings, WIDTH)
    chosen = selection.with_minimum(chosen, columns, [f"f{i}" for i in range(WIDTH)], "label")
    mean = set(selection.above_mean(scores))
    return t.spark.createDataFrame([(c, scores[c], c in mean) for c in chosen], "feature string, importance double, above_mean boolean")


@query("select_recursive")
def _(t):
    train, _ = _parts(t)
    rows = train.select("label", vector_to_array("features").alias("features"))
    kept = models.eliminate(rows, "features", list(range(20)), 10)
    return t.spark.createDataFrame([(f"f{j}",) for j in kept], "feature string")


@query("permutation_importance")
def _(t):
    train, test = _parts(t)
    model = models.classifier("tree", 10).fit(train)
    rows = test.select("vec_id", "label", vector_to_array("features").alias("features"))
    lost = models.permutation_importance(model, rows, "vec_id", "features", list(range(10)))
    return t.spark.createDataFrame([(f"f{j}", float(v)) for j, v in lost], "feature string, accuracy_lost double")


@query("pca_variance")
def _(t):
    vectors = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    _, shares, k = selection.pca(vectors, "v", share=0.98, width=WIDTH)
    total, rows = 0.0, []
    for i, s in enumerate(shares):
        total += s
        rows.append((i + 1, round(s, 6), round(total, 6)))
    return t.spark.createDataFrame(rows, "component int, share double, cumulative double")


# ---- neighbours ---------------------------------------------------------------------------

KNN_SQL = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS id, b.vec_id AS neighbor, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS rank FROM pairs QUALIFY rank <= {k})"""


@query("knn_exact", f"WITH {KNN_SQL.format(k=5)} SELECT id, neighbor, round(distance, 5) AS distance, rank FROM nn")
def _(t):
    return rounded(neighbors.knn(t.embeddings, "vec_id", "embedding", 5), ["distance"], 5)


@query("knn_index", """
SELECT vec_id AS id, least(10, (SELECT count(*) FROM embeddings) - 1) AS found, TRUE AS in_order, TRUE AS recall_met FROM embeddings WHERE vec_id % 100 = 0""")
def _(t):
    # Every hundredth id asks all rows; the recall is measured on other, sampled rows against all rows.
    index = vector_index.build(t.embeddings, "vec_id", "embedding", scratch(t.spark, "index"))
    met = vector_index.recall(t.spark, index) >= 0.9
    found = vector_index.search(index, t.embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding")
    in_order = F.array_sort(F.collect_list(F.struct("rank", "distance")))
    ranked = found.groupBy("id").agg(F.count(F.lit(1)).alias("found"), in_order.alias("r"))
    return ranked.select("id", "found", (F.col("r.distance") == F.array_sort("r.distance")).alias("in_order"), F.lit(met).alias("recall_met"))


@query("knn_vote", f"""
WITH {KNN_SQL.format(k=5)}, c AS (SELECT id, label, count(*) AS n FROM nn JOIN v ON v.vec_id = neighbor GROUP BY id, label)
SELECT id, CAST(arg_min(label, -n * 1000 + label) AS INTEGER) AS predicted FROM c GROUP BY id""")
def _(t):
    found = neighbors.knn(t.embeddings, "vec_id", "embedding", 5)
    return neighbors.knn_vote(found, t.embeddings, "vec_id", "label")


@query("lof", f"""
WITH {KNN_SQL.format(k=20)}, kd AS (SELECT id, max(distance) AS kd FROM nn GROUP BY id),
lrd AS (SELECT nn.id, count(*) / (sum(greatest(distance, kd.kd)) + 1e-10::DOUBLE * count(*)) AS lrd FROM nn JOIN kd ON kd.id = neighbor GROUP BY nn.id)
SELECT nn.id, round(avg(o.lrd) / any_value(s.lrd), 5) AS lof FROM nn JOIN lrd o ON o.id = neighbor JOIN lrd s ON s.id = nn.id GROUP BY nn.id""")
def _(t):
    return rounded(neighbors.local_outlier_factor(neighbors.knn(t.embeddings, "vec_id", "embedding", 20), 20), ["lof"], 5)


@query("lof_novelty", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, md5(CAST(vec_id AS VARCHAR)) < '4d' AS held_out FROM embeddings),
pairs AS (SELECT a.vec_id AS id, a.held_out, b.vec_id AS neighbor, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id AND NOT b.held_out),
nn AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) <= 20),
kd AS (SELECT id, max(distance) AS kd FROM nn WHERE NOT held_out GROUP BY id),
lrd AS (SELECT nn.id, any_value(held_out) AS held_out, count(*) / (sum(greatest(distance, kd.kd)) + 1e-10::DOUBLE * count(*)) AS lrd FROM nn JOIN kd ON kd.id = neighbor GROUP BY nn.id),
f AS (SELECT nn.id, any_value(s.held_out) AS held_out, avg(o.lrd) / any_value(s.lrd) AS lof FROM nn JOIN lrd o ON o.id = neighbor JOIN lrd s ON s.id = nn.id GROUP BY nn.id)
SELECT id AS vec_id, round(lof, 5) AS score, lof > (SELECT quantile_cont(lof, 0.9) FROM f WHERE NOT held_out) AS novel FROM f WHERE held_out""")
def _(t):
    # Three tenths of the rows, by the id's hash, are scored by a model of the others.
    rows = t.embeddings.withColumn("held_out", F.md5(F.col("vec_id").cast("string")) < "4d")
    path = scratch(t.spark, "lof")
    novelty.fit_lof(rows.where("not held_out"), "vec_id", "embedding", 20, path)
    return rounded(novelty.score_lof(rows.where("held_out").select("vec_id", "embedding"), "embedding", path).select("vec_id", "score", "novel"), ["score"], 5)


@query("novelty_models")
def _(t):
    # One-class and mixture models of seven tenths of the rows score the other ones; all elements.
    rows = t.embeddings.withColumn("held_out", F.md5(F.col("vec_id").cast("string")) < "4d")
    seen, new = rows.where("not held_out"), rows.where("held_out").select("vec_id", "embedding")
    paths = {kind: scratch(t.spark, kind) for kind in ("one_class", "mixture")}
    novelty.fit_one_class(seen, "vec_id", "embedding", paths["one_class"])
    novelty.fit_mixture(seen, "vec_id", "embedding", paths["mixture"])
    parts = [novelty.score_usual(new, "embedding", path).select("vec_id", F.lit(kind).alias("model"), "score", "novel") for kind, path in paths.items()]
    return rounded(parts[0].unionByName(parts[1]), ["score"])


@query("dbscan", """
WITH p AS (SELECT event_id AS id, value / 20 AS x, CAST(props->>'$.k' AS DOUBLE) / 10 AS y FROM events),
c AS (SELECT a.id, any_value(a.x) AS x, any_value(a.y) AS y, count(*) AS n FROM p a JOIN p b ON b.x BETWEEN a.x - 0.51 AND a.x + 0.51
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25 GROUP BY a.id),
core AS (SELECT * FROM c WHERE n >= 5)
SELECT id, n < 5 AND NOT EXISTS (SELECT 1 FROM core WHERE core.x BETWEEN c.x - 0.51 AND c.x + 0.51
  AND (core.x - c.x) * (core.x - c.x) + (core.y - c.y) * (core.y - c.y) <= 0.25) AS noise FROM c""")
def _(t):
    points = t.events.select("event_id", (F.col("value") / 20).alias("x"), (F.get_json_object("props", "$.k").cast("double") / 10).alias("y"))
    return neighbors.density_noise(points, "event_id", ["x", "y"], 0.5, 5)


@query("dbscan_clusters", """
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON list_distance(a.e, b.e) <= 1.15),
c AS MATERIALIZED (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= 4),
l AS MATERIALIZED (SELECT a, b FROM p SEMI JOIN c ON c.id = a WHERE b IN (SELECT id FROM c)),
r(id, reached) AS (SELECT id, id FROM c UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
k AS (SELECT id, min(reached) AS cluster FROM r GROUP BY id),
o AS (SELECT a AS id, min(cluster) AS cluster FROM p JOIN k ON k.id = b WHERE a NOT IN (SELECT id FROM c) GROUP BY a)
SELECT v.id, coalesce(k.cluster, o.cluster) AS cluster, CASE WHEN k.id IS NOT NULL THEN 'core' WHEN o.id IS NOT NULL THEN 'border' ELSE 'noise' END AS kind
FROM v LEFT JOIN k ON k.id = v.id LEFT JOIN o ON o.id = v.id""")
def _(t):
    return density.clusters(t.embeddings, "vec_id", "embedding", 1.15, 4)


# ---- anomaly detectors ----------------------------------------------------------------------

@query("iforest")
def _(t):
    rows = t.embeddings.select("vec_id", "embedding")
    forest = anomaly.isolation_forest(rows, "vec_id", "embedding")
    scored = anomaly.isolation_score(rows, forest, "embedding").select("vec_id", "score")
    return rounded(anomaly.flag_share(scored, "score", 0.1), ["score"], 6)


@query("event_iforest")
def _(t):
    from gridlens.plans.common import packets

    rows = packets(t.events).select("packet_id", anomaly.event_vector("src", "value", "length", "event_type", F.col("event_type") == "purchase").alias("x"))
    forest = anomaly.isolation_forest(rows, "packet_id", "x")
    flagged = anomaly.flag_share(anomaly.isolation_score(rows, forest, "x").select("packet_id", "score"), "score", 0.1)
    return flagged.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("anomaly"), 1)).alias("anomalies"),
                       (1 - F.avg(F.col("anomaly").cast("double"))).alias("score"))


@query("one_class_kernel")
def _(t):
    found = anomaly.kernel_outliers(t.embeddings.select("vec_id", "embedding"), "embedding", WIDTH, 0.1)
    return rounded(found.select("vec_id", "similarity", "anomaly"), ["similarity"], 6)


@query("elliptic_envelope")
def _(t):
    rows = t.embeddings.select("vec_id", "embedding")
    mean, inverse = anomaly.gaussian_envelope(rows, "embedding", WIDTH)
    scored = rows.select("vec_id", anomaly.mahalanobis("embedding", mean, inverse).alias("distance"))
    return rounded(anomaly.flag_share(scored, "distance", 0.1), ["distance"], 3)


@query("gaussian_mixture")
def _(t):
    rows = t.embeddings.select("vec_id", F.slice("embedding", 1, 8).alias("x"))
    return rounded(anomaly.mixture_outliers(rows, "x", 2).select("vec_id", "log_likelihood", "anomaly"), ["log_likelihood"], 3)


@query("reconstruction_error")
def _(t):
    scored = anomaly.reconstruction_error(t.embeddings.select("vec_id", "embedding"), "embedding", WIDTH, 16).select("vec_id", "error")
    return rounded(anomaly.flag_share(scored, "error", 0.05), ["error"])


@query("composite_score", """
WITH e AS (SELECT event_id, value, CAST(props->>'$.k' AS DOUBLE) AS k, lag(value) OVER w AS pv, lag(CAST(props->>'$.k' AS DOUBLE)) OVER w AS pk FROM events WINDOW w AS (ORDER BY ts, event_id)),
d AS (SELECT *, coalesce(abs(value - pv), 0) AS dv, coalesce(abs(k - pk), 0) AS dk FROM e),
q AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk, quantile_cont(value, 0.05) AS lv, quantile_cont(value, 0.95) AS hv,
  quantile_cont(k, 0.05) AS lk, quantile_cont(k, 0.95) AS hk, quantile_cont(dv, 0.9) AS jv, quantile_cont(dk, 0.9) AS jk FROM d),
s AS (SELECT event_id, CAST(abs((value - mv) / sv) > 2.5 AS INTEGER) + CAST(value > hv AS INTEGER) + CAST(value < lv AS INTEGER) + coalesce(CAST(pv IS NOT NULL AND dv > jv AS INTEGER), 0)
  + CAST(abs((k - mk) / sk) > 2.5 AS INTEGER) + CAST(k > hk AS INTEGER) + CAST(k < lk AS INTEGER) + coalesce(CAST(pk IS NOT NULL AND dk > jk AS INTEGER), 0) AS rule_score FROM d, q)
SELECT event_id, rule_score, CAST(rule_score >= 1 AS INTEGER) AS anomaly FROM s""")
def _(t):
    rows = t.events.select("event_id", "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return anomaly.composite_score(rows, ["ts", "event_id"], ["value", "k"]).select("event_id", "rule_score", "anomaly")


@query("row_outliers", """
WITH r AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY vec_id),
q AS (SELECT quantile_cont(m, 0.85) AS qm, quantile_cont(s, 0.85) AS qs, quantile_cont(lo, 0.15) AS ql, quantile_cont(hi, 0.85) AS qh FROM r)
SELECT vec_id, CAST(m > qm OR s > qs OR lo < ql OR hi > qh AS INTEGER) AS anomaly FROM r, q""")
def _(t):
    return anomaly.row_outliers(t.embeddings, "embedding").select("vec_id", "anomaly")


@query("principal_rule")
def _(t):
    rows = t.embeddings.select("vec_id", F.slice("embedding", 1, 10).alias("x"))
    return anomaly.principal_outliers(rows, "x", 10).select("vec_id", "rule_score", "anomaly")


@query("consensus_rate", """
WITH f AS (SELECT value > (SELECT quantile_cont(value, 0.8) FROM events) AS large, event_type = 'error' AS failed, CAST(props->>'$.k' AS INTEGER) > 60 AS odd FROM events)
SELECT 'large' AS detector, count(*) FILTER (large) AS n_flagged, round(avg(CAST(large AS INTEGER)), 6) AS rate FROM f
UNION ALL SELECT 'failed', count(*) FILTER (failed), round(avg(CAST(failed AS INTEGER)), 6) FROM f
UNION ALL SELECT 'odd', count(*) FILTER (odd), round(avg(CAST(odd AS INTEGER)), 6) FROM f
UNION ALL SELECT 'all', count(*) FILTER (large AND failed AND odd), round(avg(CAST(large AND failed AND odd AS INTEGER)), 6) FROM f""")
def _(t):
    from gridlens.operators.quantiles import column_quantiles

    cut = column_quantiles(t.events, ["value"], [0.8])["value"][0]
    flags = t.events.select((F.col("value") > cut).alias("large"), (F.col("event_type") == "error").alias("failed"),
                            (F.get_json_object("props", "$.k").cast("int") > 60).alias("odd"))
    return rounded(anomaly.consensus(flags, ["large", "failed", "odd"]), ["rate"], 6)


@query("ablation_table")
def _(t):
    names = [f"f{i}" for i in range(16)]
    rows = vector_columns(t.embeddings, 16).withColumn("truth", (F.col("label") == 0).cast("int"))
    configs = {
        "plain": {"trees": 25}, "robust": {"trees": 25, "scale": "robust"},
        "robust+pca": {"trees": 25, "scale": "robust", "pca": 4}, "robust+select": {"trees": 25, "scale": "robust", "select": 6},
    }
    return ablation.run(rows, "vec_id", names, "truth", configs)


# ---- robustness of trained models --------------------------------------------------------------

def _unit_rows(t):
    """Embeddings scaled into [0, 1] element by element, as the perturbations expect."""
    x = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double") / 2 + 0.5)))
    return cut_lineage(t.embeddings.select("vec_id", F.col("label").cast("double").alias("label"), x.alias("features")))


def _tree_on_units(t):
    rows = _unit_rows(t)
    model = models.classifier("tree", 10, maxDepth=8).fit(rows.select("label", array_to_vector("features").alias("features")))
    return rows, model, model.featureImportances.toArray().tolist()


@query("flip_rate")
def _(t):
    rows, model, importance = _tree_on_units(t)
    moved = {
        "single_step": robust.perturb_step("original", "vec_id", importance, 0.1),
        "projected": robust.perturb_projected("original", "vec_id", importance, 0.3),
        "squeezed": robust.squeeze("original", 1),
    }
    return rounded(models.flip_rate(model, rows, moved), ["success_rate", "mean_l2"], 6)


@query("random_search")
def _(t):
    rows, model, importance = _tree_on_units(t)
    found = robust.random_search(rows, "vec_id", "features", importance, models.predictor(model), tries=10)
    return rounded(found.select("vec_id", "changed", "distance"), ["distance"], 6)


@query("randomised_smoothing")
def _(t):
    rows, model, _ = _tree_on_units(t)
    return robust.smoothed_prediction(rows, "vec_id", "features", models.predictor(model), copies=10)


@query("adversarial_retrain")
def _(t):
    rows, model, importance = _tree_on_units(t)
    change = robust.perturb_step("features", "vec_id", importance, 0.1)
    vectors = lambda d: d.select("label", array_to_vector("features").alias("features"))
    retrained = models.classifier("tree", 10, maxDepth=8).fit(vectors(models.augmented_training(rows, "vec_id", change)))
    moved = vectors(rows.withColumn("features", change))
    table = [(n, *r[1:]) for n, m in (("original", model), ("retrained", retrained)) for r in models.compare({n: m}, moved)]
    return t.spark.createDataFrame(table, "model string, accuracy double, f1 double")


@query("label_flip_impact")
def _(t):
    # Labels of training rows only are flipped; the test rows stay clean.
    marked = sampling.split(t.embeddings.select("vec_id", "label", "embedding"), "vec_id", 0.2, "label")
    marked = cut_lineage(marked)
    train, test = marked.where("not is_test"), models.as_vectors(marked.where("is_test"), "embedding", "label")
    rows = []
    for rate in (0.0, 0.10, 0.25, 0.50):
        flipped = robust.flip_labels(train, "vec_id", "label", rate)
        model = models.classifier("tree", 10, maxDepth=8).fit(models.as_vectors(flipped, "embedding", "flipped_label"))
        rows.append((rate, models.compare({"tree": model}, test)[0][1]))
    return t.spark.createDataFrame([(r, a, rows[0][1] - a) for r, a in rows], "rate double, accuracy double, drop double")
