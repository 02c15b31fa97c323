"""Edges that earlier versions got wrong: folders of different headers, columns without values, odd addresses, label words."""

import gzip

from gridlens.functions.scalar import ipv4_to_long
from gridlens.operators import models, profile, rules
from gridlens.sources import tabular


def test_folder_columns_are_bound_by_name(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.csv").write_text("id,v,w\n1,2.5,x\n2,bad,y\n")
    (tmp_path / "two.csv").write_text("w,note,id,v\nz,extra,30,3\n")
    (tmp_path / "three.csv").write_text("v,id\n7,8\n")
    (tmp_path / "none.csv").write_text("")
    whole = gzip.compress(b"id,v,w\n9,9,q\n" * 50)
    (tmp_path / "broken.csv.gz").write_bytes(whole[:8])
    good, rejects = tabular.read_folder(spark, str(tmp_path), "id bigint, v double, w string", "*.csv*")
    assert sorted(tuple(r)[:3] for r in good.collect()) == [(1, 2.5, "x"), (8, 7.0, None), (30, 3.0, "z")]
    bad = {r.source_path.split("/")[-1]: r.line for r in rejects.collect()}
    assert bad == {"one.csv": "2,bad,y", "broken.csv.gz": None}


def test_columns_without_values(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, None), (3, 99.0, None)], "id int, x double, n double")
    boxes = {r[0]: r for r in profile.box_stats(df, ["x", "n"]).collect()}
    assert boxes["n"]["q1"] is None and boxes["n"]["n_outside"] == 0 and boxes["x"]["median"] == 2.0
    outliers = {r[0]: r for r in profile.iqr_outliers(df, ["x", "n"]).collect()}
    assert outliers["n"]["n_outliers"] == 0
    bins = profile.histogram(df, "n", 4).collect()
    assert [(r.bin, r.bin_low, r.n) for r in bins] == [(k, None, 0) for k in range(4)]


def test_octets_are_bytes(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("999.1.1.1",), ("1.2.3.256",), ("255.255.255.255",), (None,), ("x",)], "ip string")
    assert [r[0] for r in df.select(ipv4_to_long("ip")).collect()] == [16909060, None, None, (1 << 32) - 1, None, None]


def test_label_words(spark):
    df = spark.createDataFrame([("normal dos",), ("benign",), ("MITM attempt",), ("view",)], "t string")
    assert [r[0] for r in df.select(rules.keyword_label("t")).collect()] == [1, 0, 1, 1]


def test_ensembles_of_boosted_and_margin_models_on_three_classes(spark):
    rows = [(i, float(i % 3), float(i % 3) + (i * 7 % 10) / 25, float((i * 13) % 11)) for i in range(150)]
    df = models.as_vectors(spark.createDataFrame(rows, "id int, y double, a double, b double"), ["a", "b"], "y", keep=("id",))
    kinds = {"boosted": {"maxIter": 2, "maxDepth": 2}, "svm": {"maxIter": 10}, "tree": {}}
    fitted = {k: models.classifier(k, 3, **p).fit(df) for k, p in kinds.items()}
    voted = models.soft_vote(fitted, df).select("label", "prediction", "probability").collect()
    assert sum(r.label == r.prediction for r in voted) > 140 and all(abs(sum(r.probability) - 1) < 1e-9 for r in voted)
    full, meta, _ = models.stack({k: models.classifier(k, 3, **kinds[k]) for k in ("boosted", "svm")}, df, "id", 3, folds=2)
    stacked = models.stack_predict(full, meta, df, "id").collect()
    assert sum(r.label == r.prediction for r in stacked) > 130
    two = models.classifier("svm", 2, maxIter=10).fit(df.where("label < 2"))
    assert len(two.transform(df).first().probability) == 2
