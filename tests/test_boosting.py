import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridlens.operators import boosting, models


def rows(spark, x, y, w=None, parts=3):
    w = np.ones(len(x)) if w is None else w
    data = [(i, None if c is None else float(c), [float(v) for v in r], float(u)) for i, (r, c, u) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame(data, "id long, label double, x array<double>, w double").repartition(parts)
    return df.withColumn("features", array_to_vector("x"))


def corners(n, seed):
    """Four classes by the signs of the first two columns: no single cut tells them apart; the third is noise."""
    x = np.random.default_rng(seed).uniform(-1, 1, (n, 3))
    return x, 2 * (x[:, 0] > 0) + (x[:, 1] > 0)


def same(a, b):
    return len(a.trees) == len(b.trees) and all(
        np.array_equal(s.feature, t.feature) and np.array_equal(s.cut, t.cut) and np.array_equal(s.value, t.value) for s, t in zip(a.trees, b.trees))


def test_learns_all_classes_in_one_fit(spark):
    model = boosting.BoostedTrees(maxIter=8, maxDepth=2, stepSize=0.5).fit(rows(spark, *corners(400, 1)))
    scored = model.transform(rows(spark, *corners(300, 2)))
    found = scored.select("label", "prediction", "probability").collect()
    assert np.mean([r["label"] == r["prediction"] for r in found]) > 0.95
    assert all(abs(r["probability"].toArray().sum() - 1) < 1e-9 and len(r["probability"]) == 4 for r in found)
    assert model.featureImportances.toArray()[2] < 0.1 and len(model.trees) == 8


def brute_first_cut(x, y, classes, cuts, penalty, least):
    """Best first cut by the definition: every column, every cut, from class shares."""
    share = np.bincount(y, minlength=classes) / len(y)
    g, h = share[None] - np.eye(classes)[y], np.repeat((share * (1 - share))[None], len(y), 0)
    value = lambda m: (g[m].sum(0) ** 2 / (h[m].sum(0) + penalty)).sum()
    best = None
    for j, edges in enumerate(cuts):
        for b, c in enumerate(edges):
            low = x[:, j] <= c
            if h[low].sum() < least or h[~low].sum() < least:
                continue
            gain = value(low) + value(~low) - value(np.ones(len(y), bool))
            if best is None or gain > best[0] + 1e-9:
                best = (gain, j, b + 1, -g[low].sum(0) / (h[low].sum(0) + penalty), -g[~low].sum(0) / (h[~low].sum(0) + penalty))
    return best


def test_first_cut_equals_brute_force(spark):
    draw = np.random.default_rng(3)
    x = np.round(draw.normal(size=(250, 4)), 2)
    y = np.digitize(x[:, 2] + 0.3 * x[:, 1], [-0.4, 0.5])
    fit = boosting.BoostedTrees(maxIter=1, maxDepth=1, stepSize=1.0, subsamplingRate=1.0, columnRate=1.0, maxBins=16).fit(rows(spark, x, y))
    for j, edges in enumerate(fit.cuts):
        assert np.allclose(edges, np.unique(np.quantile(x[:, j], np.arange(1, 16) / 16)))
    gain, feature, cut, low, high = brute_first_cut(x, y, 3, fit.cuts, 1.0, 1.0)
    tree = fit.trees[0]
    assert (tree.feature[0], tree.cut[0]) == (feature, cut) and fit.gains[feature] == pytest.approx(gain, rel=1e-5)
    assert np.allclose(tree.value[1], low, atol=1e-5) and np.allclose(tree.value[2], high, atol=1e-5)


def test_same_model_however_rows_lie_and_sums_are_merged(spark, monkeypatch):
    x, y = corners(300, 4)
    fit = lambda parts: boosting.BoostedTrees(maxIter=11, maxDepth=2, idCol="id").fit(rows(spark, x, y, parts=parts))
    plain = fit(1)
    monkeypatch.setattr(boosting, "FAN_IN", 2)  # two merging steps
    monkeypatch.setattr(boosting, "SUMS", 1)  # one node a pass
    monkeypatch.setattr(boosting, "BLOCK", 16)
    assert same(plain, fit(5))
    assert not same(plain, boosting.BoostedTrees(maxIter=11, maxDepth=2, idCol="id", seed=1).fit(rows(spark, x, y)))


def test_weights_are_repeated_rows(spark):
    x, y = corners(120, 5)
    w = np.random.default_rng(5).integers(1, 4, 120)
    whole = dict(maxIter=4, maxDepth=2, subsamplingRate=1.0, maxBins=254)
    weighted = boosting.BoostedTrees(weightCol="w", **whole).fit(rows(spark, x, y, w))
    again = np.repeat(np.arange(120), w)
    repeated = boosting.BoostedTrees(**whole).fit(rows(spark, x[again], y[again]))
    # Cuts are quantiles of rows, so they differ a little between the two.
    score = lambda m: np.array([r["probability"].toArray() for r in m.transform(rows(spark, x, y)).orderBy("id").collect()])
    assert np.abs(score(weighted) - score(repeated)).max() < 0.1
    assert np.allclose(weighted.base, repeated.base)


def test_missing_values_short_vectors_and_unusable_rows(spark):
    x, y = corners(200, 6)
    x[y == 3, 2] = np.nan  # missing values tell the last class
    labels = [None if i < 5 else c for i, c in enumerate(y)]
    df = rows(spark, x, labels)
    odd = spark.createDataFrame([(900, 1.0, [], 1.0), (901, 0.0, [-0.5], 1.0), (902, 1.0, [0.5, 0.5, 0.1], 0.0)], "id long, label double, x array<double>, w double")
    df = df.unionByName(odd.withColumn("features", array_to_vector("x")))
    model = boosting.BoostedTrees(maxIter=6, maxDepth=3, stepSize=0.5, weightCol="w").fit(df)
    scored = model.transform(df.withColumn("probability", F.lit("clash")))
    assert scored.count() == 203 and scored.where("prediction is null").count() == 0
    got = {r["id"]: r["prediction"] for r in scored.collect()}
    assert np.mean([got[i] == y[i] for i in range(5, 200)]) > 0.95 and 901 in got


def test_degenerate_tables(spark):
    x, y = corners(30, 7)
    with pytest.raises(ValueError, match="no rows"):
        boosting.BoostedTrees().fit(rows(spark, x, y).where("id < 0"))
    with pytest.raises(ValueError, match="from 0"):
        boosting.BoostedTrees().fit(rows(spark, x, y - 1))
    one = boosting.BoostedTrees(maxIter=3).fit(rows(spark, x, np.zeros(30)))
    assert {r["prediction"] for r in one.transform(rows(spark, x, y)).collect()} == {0.0}
    constant = boosting.BoostedTrees(maxIter=3).fit(rows(spark, np.ones((30, 2)), y))
    assert constant.trees == [] and constant.transform(rows(spark, x, y).where("id < 0")).count() == 0


def test_saved_in_a_bundle_and_searched(spark, tmp_path):
    x, y = corners(200, 8)
    df = rows(spark, x, y)
    fitted = Pipeline(stages=[models.classifier("histogram", 4, maxIter=3, maxDepth=2, stepSize=0.5)]).fit(df)
    models.save_bundle(str(tmp_path / "b"), fitted, ["a", "b", "c"], list("wxyz"), spark)
    loaded, _, labels = models.load_bundle(str(tmp_path / "b"), spark)
    assert isinstance(loaded, PipelineModel) and labels == list("wxyz")
    a, b = fitted.stages[0], loaded.stages[0]
    assert same(a, b) and b.value("maxDepth") == 2 and np.array_equal(a.base, b.base) and all(map(np.array_equal, a.cuts, b.cuts))
    best, table = models.grid_search("histogram", df, "id", 4, {"maxDepth": [1, 2], "maxIter": [1], "stepSize": [1.0]}, folds=2)
    assert table[0][0]["maxDepth"] == 2 and best.value("maxDepth") == 2
