import pytest

from gridlens.operators import models
from gridlens.streaming import serving, streams

SCHEMA = "id long, x array<double>, label string, features int"


def fitted(spark, cut):
    """A tree that tells the first element at ``cut``."""
    rows = spark.createDataFrame([(float(i), float(i % 7), int(i >= cut)) for i in range(100)], "f0 double, f1 double, y int")
    return models.fit_pipeline("tree", rows, ["f0", "f1"], "y", 2, maxBins=128)


def requests(spark, ids):
    odd = {3: None, 4: [], 5: [1.0], 6: [None, 1.0], 7: [float("nan"), 0.0]}
    return spark.createDataFrame([(i, odd.get(i, [float(i), 0.0]), "kept", 9) for i in ids], SCHEMA)


def test_requests(spark):
    scored = serving.score_requests(requests(spark, range(100)), "x", (fitted(spark, 50), ["f0", "f1"], ["low", "high"]))
    got = {r["id"]: r for r in scored.collect()}
    assert [got[i]["reject"] for i in range(2, 9)] == [None, "empty", "empty", "width", "not_numeric", "not_numeric", None]
    assert all(got[i]["predicted"] is None and got[i]["confidence"] is None for i in range(3, 8))
    assert all(got[i]["predicted"] == ("high" if i >= 50 else "low") and got[i]["confidence"] == 1.0 for i in got if not 3 <= i < 8)
    assert got[9]["label"] == "kept" and got[9]["features"] == 9
    assert serving.score_requests(requests(spark, [1]).where("id < 0"), "x", (fitted(spark, 50), ["f0", "f1"], ["a", "b"])).count() == 0


def test_a_newer_model_between_batches_and_a_replay(spark, tmp_path):
    store = serving.ModelStore(spark, str(tmp_path / "store"))
    schema = requests(spark, [1]).schema
    table, each = serving.scoring_sink(store, str(tmp_path / "out"), "x", schema)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    step = lambda: streams.run_available(stream(), str(tmp_path / "check"), each=each)
    requests(spark, range(100)).coalesce(1).write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="no model"):
        each(requests(spark, [1]), 0)
    assert store.publish(fitted(spark, 50), ["f0", "f1"], ["low", "high"]) == 1
    step()
    assert store.publish(fitted(spark, 20), ["f0", "f1"], ["low", "high"]) == 2
    requests(spark, range(100, 110)).unionByName(requests(spark, [30])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    step()
    rows = table.read(spark).where("id = 30").select("version", "predicted").collect()
    assert sorted(map(tuple, rows)) == [(1, "low"), (2, "high")] and table.read(spark).count() == 111
    each(requests(spark, range(100)), 0)  # the first batch again: the version it noted
    assert table.own(spark, 0).where("id = 30").select("version", "predicted").collect() == [(1, "low")]
    # The stream's rows equal the batch form.
    whole = serving.score_requests(requests(spark, range(100)), "x", store.load(1)).select("id", "reject", "predicted", "confidence")
    assert table.own(spark, 0).select(*whole.columns).exceptAll(whole).count() == 0
