import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridlens.operators import anomaly, ensemble, evaluate, models, neighbors, privacy, profile, robust, selection


def frame(spark, x, label=None):
    label = [0] * len(x) if label is None else label
    return spark.createDataFrame([(i, [float(v) for v in r], int(y)) for i, (r, y) in enumerate(zip(x, label))],
                                 "id bigint, x array<double>, label int").repartition(5)


def brute_knn(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (round(d[i, j], 9), j))[:k]
        out[i] = order
    return out, d


@pytest.mark.parametrize("chunk,pivots", [(2000, None), (16, 5)])
def test_knn_exact_with_copies(spark, chunk, pivots):
    draw = np.random.default_rng(7)
    x = np.round(draw.normal(size=(180, 3)) * np.array([5, 1, 1]), 3)
    x[60:120] = x[60]  # a third of all rows are copies
    x[150] = x[151]
    want, d = brute_knn(x, 4)
    got = neighbors.knn(frame(spark, x), "id", "x", 4, chunk=chunk, pivots=pivots).collect()
    for i, ids in want.items():
        mine = sorted((r["rank"], r["neighbor"], r["distance"]) for r in got if r["id"] == i)
        assert [m[1] for m in mine] == ids and np.allclose([m[2] for m in mine], [d[i, j] for j in ids])


def test_knn_of_few_rows(spark):
    got = neighbors.knn(frame(spark, np.array([[0.0], [1.0]])), "id", "x", 5).collect()
    assert sorted((r["id"], r["neighbor"]) for r in got) == [(0, 1), (1, 0)]


def test_vote_and_outlier_factor(spark):
    draw = np.random.default_rng(8)
    x = np.vstack([draw.normal(0, 1, (40, 2)), draw.normal(8, 1, (40, 2)), [[4.0, 30.0]]])
    df = frame(spark, x, [0] * 40 + [1] * 40 + [1])
    near = neighbors.knn(df, "id", "x", 5)
    predicted = {r["id"]: r["predicted"] for r in neighbors.knn_vote(near, df, "id", "label").collect()}
    assert all(predicted[i] == (0 if i < 40 else 1) for i in range(80))
    lof = {r["id"]: r["lof"] for r in neighbors.local_outlier_factor(near, 5).collect()}
    assert max(lof, key=lof.get) == 80 and lof[80] > 3


@pytest.mark.parametrize("d", [1, 2, 3])
def test_density_noise_against_brute_force(spark, d):
    draw = np.random.default_rng(d)
    x = np.vstack([draw.uniform(0, 4, (150, d)), np.full((40, d), 1.5), draw.normal(3, 0.05, (30, d))])
    x[0] = 9.0
    eps, least = {1: 0.02, 2: 0.2, 3: 0.5}[d], 4
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = dist.sum(1) >= least
    want = ~core & ~(dist & core[None]).any(1)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"f{j} double" for j in range(d)))
    got = {r["id"]: r["noise"] for r in neighbors.density_noise(df, "id", [f"f{j}" for j in range(d)], eps, least).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist() and want.any() and not want.all()


def test_average_path_values():
    # Closed form of the mean unsuccessful search length.
    assert [anomaly.average_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert np.isclose(anomaly.average_path(5), 2.327020052042847) and np.isclose(anomaly.average_path(999), 2 * (np.log(998) + np.euler_gamma) - 2 * 998 / 999)


@pytest.mark.parametrize("trees", [50, 3])  # a small table is sampled per tree, a large one is dealt out
def test_isolation_forest_ranks_outliers_first(spark, trees):
    draw = np.random.default_rng(1)
    x = np.vstack([draw.normal(0, 1, (800, 2)), [[6.0, 6.0], [-7.0, 5.0]]])
    df = frame(spark, x)
    model = anomaly.isolation_forest(df, "id", "x", trees=trees)
    assert len(model) == trees and max(len(t["feature"]) for t in model) < 512
    again = anomaly.isolation_forest(df.repartition(2), "id", "x", trees=trees)
    assert model[0]["cut"] == again[0]["cut"]
    scored = anomaly.isolation_score(df, model, "x").orderBy(F.desc("score")).limit(10 if trees < 10 else 5).collect()
    assert {800, 801} <= {r["id"] for r in scored}
    flagged = anomaly.flag_share(anomaly.isolation_score(df, model, "x").select("id", "score"), "score", 0.1)
    assert 60 <= flagged.where("anomaly").count() <= 81


def test_isolation_forest_on_equal_rows(spark):
    df = frame(spark, np.ones((50, 3)))
    model = anomaly.isolation_forest(df, "id", "x", trees=5)
    flagged = anomaly.flag_share(anomaly.isolation_score(df, model, "x").select("id", "score"), "score", 0.1)
    assert flagged.where("anomaly").count() == 0


def blob_with_outliers(spark):
    draw = np.random.default_rng(2)
    x = draw.multivariate_normal([1, 2], [[2, 1.2], [1.2, 1]], 300)
    x[:6] = [[8, -6], [9, -7], [-8, 9], [7, -5], [-6, 8], [10, -8]]
    return frame(spark, x), set(range(6)), x


def test_envelope_mixture_kernel_reconstruction(spark):
    df, odd, x = blob_with_outliers(spark)
    mean, inverse = anomaly.gaussian_envelope(df, "x", 2)
    scored = df.select("id", anomaly.mahalanobis("x", mean, inverse).alias("d"))
    delta = x[7] - mean
    assert np.isclose(scored.where("id = 7").first()["d"], delta @ inverse @ delta)
    flagged = {
        "envelope": anomaly.flag_share(scored, "d", 0.02),
        "mixture": anomaly.mixture_outliers(df, "x", 2, 0.1),
        "kernel": anomaly.kernel_outliers(df, "x", 2, 0.02, gamma=0.2),
        "reconstruction": anomaly.flag_share(anomaly.reconstruction_error(df, "x", 2, 1).select("id", "error"), "error", 0.02),
    }
    for name, f in flagged.items():
        assert len(odd & {r["id"] for r in f.where("anomaly").collect()}) >= 4, name


def test_composite_skips_constant_columns(spark):
    df = spark.createDataFrame([(i, 1.0, 5.0 if i != 17 else 500.0) for i in range(40)], "id int, c double, v double")
    out = {r["id"]: r["rule_score"] for r in anomaly.composite_score(df, ["id"], ["c", "v"]).collect()}
    assert out[17] == 3 and out[3] == 0  # z, upper tail and jump


# ---- supervised ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def blobs(spark):
    draw = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [4, 0, 0], [0, 4, 0]])
    label = draw.integers(0, 3, 450)
    df = frame(spark, centres[label] + draw.normal(0, 0.8, (450, 3)), label)
    return models.as_vectors(df, "x", "label", keep=("id",)).cache()


def rate(scored):
    return evaluate.accuracy(scored, "label", "prediction").first()["accuracy"]


@pytest.mark.parametrize("kind,params", [("tree", {}), ("forest", {"numTrees": 10}), ("mlp", {"layers": [3, 8, 3]}), ("logistic", {}),
                                         ("boosted", {"maxIter": 3}), ("svm", {"maxIter": 10})])
def test_classifiers_learn(blobs, kind, params):
    assert rate(models.classifier(kind, 3, 3, **params).fit(blobs).transform(blobs)) > 0.9


def test_boosting_beats_one_stump(blobs):
    fitted = models.fit_adaboost(blobs, 3, rounds=8)
    assert rate(models.adaboost_predict(blobs, fitted, 3)) > 0.9 > rate(fitted[0][1].transform(blobs))


def test_votes(spark):
    df = spark.createDataFrame([(1, 1, 0, [0.6, 0.4], [0.1, 0.9]), (0, 0, 1, [0.5, 0.5], [0.5, 0.5])], "a int, b int, c int, p array<double>, q array<double>")
    got = df.select(ensemble.hard_vote(["a", "b", "c"]), ensemble.rounded_vote(["a", "c"]), ensemble.soft_vote(["p", "q"], [3.0, 1.0]),
                    ensemble.top_class(ensemble.soft_vote(["p", "q"]))).collect()
    assert got[0][0] == 1 and got[1][0] == 0 and got[0][1] == 0
    assert np.allclose(got[0][2], [0.475, 0.525]) and got[0][3] == 1.0 and got[1][3] == 0.0


def test_soft_vote_and_stack(blobs):
    fitted = {k: models.classifier(k, 3).fit(blobs) for k in ("tree", "logistic")}
    voted = models.soft_vote(fitted, blobs)
    assert rate(voted) > 0.9
    full, meta, held = models.stack({k: models.classifier(k, 3) for k in ("tree", "logistic")}, blobs, "id", 3, folds=3)
    assert held.count() == 450 and len(held.first()["features"]) == 6
    assert rate(models.stack_predict(full, meta, blobs, "id")) > 0.9


def test_search_and_cross_validation(blobs):
    best, table = models.grid_search("tree", blobs, "id", 3, {"maxDepth": [1, 5]}, folds=3)
    assert table[0][0] == {"maxDepth": 5} and best.depth <= 5
    mean, spread = models.cross_validate("tree", blobs, "id", 3, folds=3)
    assert mean > 0.85 and 0 <= spread < 0.2


@pytest.mark.parametrize("kind,classes,grid", [("svm", 2, {"maxIter": [5, 10]}), ("boosted", 3, {"maxIter": [1]})])
def test_search_over_one_against_rest(blobs, kind, classes, grid):
    rows = blobs.where(F.col("label") < classes)
    best, table = models.grid_search(kind, rows, "id", classes, grid, folds=2)
    assert sorted(next(iter(p.values())) for p, _ in table) == sorted(next(iter(grid.values()))) and rate(best.transform(rows)) > 0.9


@pytest.mark.parametrize("kind,classes,params", [("svm", 2, {"maxIter": 5}), ("svm", 3, {"maxIter": 5}), ("boosted", 3, {"maxIter": 2})])
def test_bundles_of_one_against_rest(spark, tmp_path, kind, classes, params):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), int(i % classes)) for i in range(120)], "id int, a double, b double, y int")
    model = models.fit_pipeline(kind, df, ["a", "b"], "y", classes, **params)
    models.save_bundle(str(tmp_path), model, ["a", "b"], [str(c) for c in range(classes)], spark)
    again, features, _ = models.load_bundle(str(tmp_path), spark)
    scored = lambda m: [(r.id, r.prediction, list(r.probability)) for r in m.transform(df.withColumn("label", F.col("y").cast("double"))).orderBy("id").select("id", "prediction", "probability").collect()]
    assert features == ["a", "b"] and scored(again) == scored(model)


def test_importance_elimination_and_selection(blobs, spark):
    model = models.classifier("tree", 3).fit(blobs)
    rows = blobs.select("id", "label", F.expr("array()").cast("array<double>").alias("none"), "features")
    from pyspark.ml.functions import vector_to_array

    rows = rows.withColumn("features", vector_to_array("features"))
    lost = dict(models.permutation_importance(model, rows, "id", "features", [0, 1, 2]))
    assert lost[0] > 0.2 and lost[1] > 0.2 and abs(lost[2]) < 0.1
    assert sorted(models.eliminate(rows, "features", [0, 1, 2], 2, step=1)) == [0, 1]
    scores = dict(models.importance_table(model, ["a", "b", "c"]))
    assert set(selection.above_mean(scores)) == {"a", "b"} and set(selection.above_percentile(scores, 25)) == {"a", "b"}


def test_bundle_and_failed_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(100)], "id int, a double, b double, y int")
    names = ["a", "b"]
    calls = []

    def train():
        calls.append(1)
        return models.fit_pipeline("tree", df, names, "y", 2), names, ["NORMAL", "ATTACK"]

    first = models.load_or_train(str(tmp_path), spark, train)
    model, features, labels = models.load_or_train(str(tmp_path), spark, train)
    assert len(calls) == 1 and features == names and labels == first[2]
    asked = spark.createDataFrame([(1, 6.0, "x"), (2, None, "x"), (3, float("nan"), "x"), (4, 0.0, "x")], "id int, a double, extra string")
    got = {r["id"]: r["prediction"] for r in models.batch_score(model, asked, features, "id").collect()}
    assert got == {1: 1.0, 2: -1.0, 3: -1.0, 4: 0.0}


def test_kernel_vectors_separate_rings(spark):
    draw = np.random.default_rng(6)
    angle, label = draw.uniform(0, 6.28, 300), draw.integers(0, 2, 300)
    x = np.c_[np.cos(angle), np.sin(angle)] * (1 + 2 * label)[:, None]
    rows = models.as_vectors(frame(spark, x, label), "x", "label")
    lifted = models.kernel_vectors(rows, "features", 2)
    linear = rate(models.classifier("svm", 2).fit(rows).transform(rows))
    assert rate(models.classifier("svm", 2).fit(lifted).transform(lifted)) > 0.95 > linear


def test_pca_choice(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(200, 1)) @ np.array([[3.0, 1.0, 0.0]]) + draw.normal(0, 0.05, (200, 3)) + 10
    df = frame(spark, x).withColumn("v", array_to_vector("x"))
    _, shares, k = selection.pca(df, "v", share=0.95, width=3)
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert k == 1 and np.isclose(shares[0], want[0] / want.sum())


def test_filters(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, float(i % 2), 1.0) for i in range(30)], "a double, b double, y double, c double")
    assert selection.correlation_prune(df, ["a", "b", "y", "c"]) == ["b"]
    kept = {r["column_name"]: r["kept"] for r in selection.variance_filter(df, ["a", "c"]).collect()}
    assert kept == {"a": True, "c": False}
    f = {r["column_name"]: r["f_value"] for r in selection.anova_f(df, ["a", "c"], "y").collect()}
    assert f["a"] < 1 and f["c"] is None
    assert selection.k_best(selection.anova_f(df, ["a", "c"], "y"), "f_value", 1) == ["a"]
    mi = {r["column_name"]: r["mutual_information"] for r in selection.mutual_information(df, ["y", "c"], "y").collect()}
    assert np.isclose(mi["y"], np.log(2)) and np.isclose(mi["c"], 0.0)


# ---- evaluation --------------------------------------------------------------------------------

def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "t int, p int")
    got = {r["class"]: tuple(r)[1:] for r in evaluate.classification_report(df, "t", "p").collect()}
    assert got["1"] == (0.0, 0.0, 0.0, 1) and np.allclose(got["0"], (2 / 3, 1.0, 0.8, 2)) and got["macro"][3] == 4
    assert {tuple(r) for r in evaluate.confusion_matrix(df, "t", "p").collect()} >= {(1, 0, 1), (1, 1, 0), (2, 1, 0)}


def test_auc_ties_nulls_and_one_class(spark):
    auc = lambda rows: evaluate.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()["auc"]
    assert auc([(1, 0.9), (0, 0.1)]) == 1.0 and auc([(1, 0.5), (0, 0.5)]) == 0.5
    assert auc([(1, 0.8), (0, 0.8), (1, 0.9), (0, 0.1), (0, None)]) == 0.875
    assert auc([(1, 0.8), (1, 0.1)]) is None


def test_label_types_are_aligned(spark):
    df = spark.createDataFrame([("0", 0.0), ("1.0", 1.0), ("-2", -2.0), ("x", 1.5)], "a string, b double")
    got = df.select(evaluate.canonical_label("a").alias("a"), evaluate.canonical_label("b").alias("b")).collect()
    assert [r["a"] for r in got] == ["0", "1", "-2", "x"] and [r["b"] for r in got] == ["0", "1", "-2", "1.5"]


def test_threshold_search_separates(spark):
    df = spark.createDataFrame([(1, 0.1)] * 20 + [(0, 0.5 + i / 200) for i in range(80)], "y int, s double")
    out = evaluate.threshold_search(df, "y", "s")
    best = out.where("chosen").first()
    assert out.count() == 80 and best["f1"] == 1.0


# ---- robustness, privacy -------------------------------------------------------------------------

def test_perturbations_stay_in_their_ball(spark):
    draw = np.random.default_rng(4)
    df = frame(spark, draw.uniform(0, 1, (60, 6)))
    weights = [0.5, 0.3, 0.2, 0.0, 0.005, 0.0]
    out = df.select("x", robust.perturb_step("x", "id", weights, 0.1).alias("s"), robust.perturb_projected("x", "id", weights, 0.05).alias("p")).collect()
    x, s, p = (np.array([r[c] for r in out]) for c in ("x", "s", "p"))
    assert np.all((s >= 0) & (s <= 1)) and np.allclose(np.abs(s - x)[:, 3], 0) and np.all(np.abs(s - x) <= np.array(weights) + 1e-9)
    assert np.linalg.norm(p - x, axis=1).max() <= 0.05 + 1e-9 and np.allclose((p - x)[:, 3:], 0) and np.linalg.norm(p - x, axis=1).mean() > 0.02


def test_counts_and_bounds_of_corruption(spark):
    df = spark.range(1000).select("id", (F.col("id") * 1.0).alias("v"), F.concat(F.lit("k"), F.col("id") % 3).alias("label"),
                                  F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    out = robust.corrupt_rows(df, "id", ["v"], 0.1)
    assert out.count() == 1000 and out.where("corrupted").count() == 100
    assert out.agg(F.sum("v")).first()[0] == 499500.0  # values only change places
    flipped = robust.flip_labels(df, "id", "label", 0.25)
    assert flipped.where("is_flipped").count() == 250 and flipped.where("flipped_label <> label").count() == 250
    moved = robust.jitter_time(df, "id", "ts").select(F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200).toDF("s")
    row = moved.agg(F.min("s"), F.max("s"), F.count_distinct("s")).first()
    assert row[0] == -10 and row[1] == 9 and row[2] == 20
    assert robust.augment(df, "id", ["v"]).count() == 3000
    same = robust.stability_index(df.unionAll(df.withColumn("ts", F.lit("2025-01-01").cast("timestamp_ntz"))), ["v"], F.year("ts") == 2025)
    assert abs(same.first()["psi"]) < 1e-12


def test_search_smoothing_and_flips(spark, blobs):
    from pyspark.ml.functions import vector_to_array

    unit = blobs.select("id", "label", F.transform(vector_to_array("features"), lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / 8 + 0.3))).alias("features"))
    model = models.classifier("tree", 3, maxDepth=4).fit(unit.select("label", array_to_vector("features").alias("features")))
    predict = models.predictor(model)
    found = robust.random_search(unit, "id", "features", [1.0, 1.0, 1.0], predict, tries=15)
    assert found.count() == 450 and 0 < found.where("changed").count() < 450
    assert found.where("changed and distance is null").count() == 0
    base = {r["id"]: r["prediction"] for r in predict(unit).collect()}
    smooth = robust.smoothed_prediction(unit, "id", "features", predict, copies=5, sigma=0.001).collect()
    assert sum(base[r["id"]] == r["smoothed"] for r in smooth) > 400
    rates = {r["method"]: r for r in models.flip_rate(model, unit, {"none": F.col("original"), "step": robust.perturb_step("original", "id", [1, 1, 0], 0.05)}).collect()}
    assert rates["none"]["success_rate"] == 0 and rates["none"]["mean_l2"] == 0 and rates["step"]["success_rate"] > 0


def test_privacy(spark):
    df = spark.range(20000).select("id", (F.col("id") % 100 * 1.0).alias("v"), F.lit(3.0).alias("c"))
    noisy = privacy.laplace_noise(df, "id", ["v"], 1.0, sensitivity=1.0).join(df.select("id", F.col("v").alias("w")), "id")
    assert abs(noisy.agg(F.avg(F.col("v") - F.col("w"))).first()[0]) < 0.05
    masked = privacy.mask_numeric(df, "id", ["v"]).agg(F.min("v"), F.max("v")).first()
    assert masked[0] == 0 and masked[1] <= 99 * 617 * 1.001
    h = {r["column_name"]: r for r in privacy.entropy_redundancy(df, ["c"]).collect()}
    assert np.isclose(h["c"]["entropy"], np.log2(20000)) and h["c"]["redundancy"] is None
    pairs = {"v": ("v", "v"), "c": ("c", "c")}
    assert all(abs(r["kl"]) < 1e-9 for r in privacy.kl_divergence(df, pairs).collect())
    assert all(np.isclose(r["similarity"], 1) and r["scaled"] == 0 for r in privacy.cosine_columns(df, pairs).collect())


def test_pattern_summary_keeps_the_first_hundred(spark):
    df = spark.range(300).select(F.lit("a").alias("kind"), F.format_string("10.0.0.%03d", F.col("id")).alias("src"), F.lit(1.0).alias("sev"), F.lit(2.0).alias("size"))
    row = profile.pattern_summary(df, ["kind"], "src", "sev", "size").first()
    names = row["first_sources"].split(",")
    assert row["n_sources"] == 300 and len(names) == 100 and names[0] == "10.0.0.000" and names[-1] == "10.0.0.099"
