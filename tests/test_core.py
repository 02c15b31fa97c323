import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.functions import hashing, names, scalar
from gridlens.operators import ordered, quantiles


@pytest.fixture(scope="module")
def series(spark):
    draw = random.Random(3)
    # Source 0 has half of all rows; one source is null; values have gaps and ties.
    data = [
        (i, draw.choice([0, 0, 0, 0, 1, 2, 3, None]), draw.randrange(40), None if draw.random() < 0.2 else float(draw.randrange(9)))
        for i in range(600)
    ]
    return spark.createDataFrame(data, "id int, src int, t int, v double").repartition(5).cache()


def steps():
    return [
        ordered.lag("prev", "v"), ordered.running("total", "sum", "v"), ordered.running("seen", "count", "v"), ordered.row_number("rn"),
        ordered.running("top", "max", "v"), ordered.running("low", "min", "v"), ordered.running("known", "last", "v"),
    ]


@pytest.mark.parametrize("by", [["src"], []])
@pytest.mark.parametrize("order", ["up", "down"])
def test_split_scan_equals_window(series, rows, by, order):
    keys = ["t", "id"] if order == "up" else [F.desc("t"), F.desc("id")]
    plain = rows(ordered.scan(series, by, keys, steps(), split=False))
    assert rows(ordered.scan(series, by, keys, steps(), split=True)) == plain


def test_split_is_chosen_by_the_largest_group(spark, series):
    assert ordered.largest_group(series, ["src"]) > 250
    spark.conf.set("spark.gridlens.maxGroupRows", "10")
    try:
        plan = ordered.scan(series, ["src"], ["t", "id"], steps())._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.gridlens.maxGroupRows")
    assert "__blk" in plan


def test_scan_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, v double")
    assert ordered.scan(empty, [], ["id"], [ordered.row_number("rn")], split=True).count() == 0


@pytest.mark.parametrize("kind", ["spread", "ties", "heavy_tail", "constant", "two"])
def test_exact_quantiles(spark, monkeypatch, kind):
    draw = np.random.default_rng(1)
    x = {
        "spread": draw.normal(size=3000), "ties": draw.integers(0, 3, 3000).astype(float), "heavy_tail": 10 ** draw.uniform(-200, 200, 3000),
        "constant": np.full(50, 2.5), "two": np.array([1.0] * 500 + [2.0] * 501),
    }[kind]
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 7, "v double").repartition(6)
    want = np.quantile(x, probs)
    assert np.allclose(quantiles.column_quantiles(df, ["v"], probs)["v"], want, rtol=1e-12)
    monkeypatch.setattr(quantiles, "_ACCURACY", 50)
    assert np.allclose(quantiles.column_quantiles(df, ["v"], probs, limit=20)["v"], want, rtol=1e-12)


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "a double, b double")
    assert quantiles.column_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [2.0]}
    assert quantiles.column_quantiles(df, ["a", "b"], [0.5], limit=1) == {"a": [None], "b": [2.0]}


def test_group_quantiles_split(series, rows):
    plain = quantiles.group_quantiles(series, ["src"], "v", [0.1, 0.5, 0.9], split=False)
    parted = quantiles.group_quantiles(series, ["src"], "v", [0.1, 0.5, 0.9], split=True)
    for a, b in zip(rows(plain), rows(parted)):
        assert a[0] == b[0] and np.allclose(a[1], b[1])


def test_hash_is_uniform_and_repeatable(spark, rows):
    df = spark.range(20000).select("id", hashing.unit("id", 5).alias("u"), hashing.gaussian("id", 5).alias("g"))
    u = np.array([r["u"] for r in df.orderBy("id").collect()])
    assert 0 < u.min() and u.max() < 1
    counts = np.histogram(u, bins=20, range=(0, 1))[0]
    assert ((counts - 1000) ** 2 / 1000).sum() < 45  # chi-squared, 19 degrees
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.03
    g = np.array([r["g"] for r in df.collect()])
    assert abs(g.mean()) < 0.03 and abs(g.std() - 1) < 0.03
    assert rows(df.repartition(7), "id", "u")[:50] == rows(df.coalesce(1), "id", "u")[:50]


def test_hash_of_large_and_negative_ids(spark):
    df = spark.createDataFrame([(2**62,), (-5,), (0,)], "id bigint").select(hashing.hash31("id", 1).alias("h"))
    assert all(0 <= r["h"] < hashing.M31 for r in df.collect())


def test_laplace_scale(spark):
    df = spark.range(20000).select(hashing.laplace("id", 3, 2.0).alias("x"))
    row = df.agg(F.avg("x").alias("m"), F.avg(F.abs("x")).alias("a")).first()
    assert abs(row["m"]) < 0.1 and abs(row["a"] - 2.0) < 0.1


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    f = lambda v: F.lit(v).cast("double")
    assert one(spark, scalar.finite(f(float("inf"))), scalar.finite(f(float("nan"))), scalar.finite(f(-1.5))) == (None, None, -1.5)
    assert one(spark, scalar.to_number(F.lit("No Label")), scalar.to_number(F.lit("No Label"), 0), scalar.to_number(F.lit("7.5"))) == (None, 0.0, 7.5)
    assert one(spark, scalar.ratio(f(1.0), f(0.0)), scalar.ratio(f(1.0), f(4.0))) == (0.0, 0.25)
    assert one(spark, scalar.ipv4_to_long(F.lit("10.1.5.7")), scalar.ipv4_to_long(F.lit("08:00:27:aa:bb:cc"))) == (167838983, None)
    assert one(spark, *[scalar.severity_band(f(v)) for v in (0.85, 0.86)]) == ("MEDIUM", "HIGH")
    assert one(spark, *[scalar.severity_band(f(v), "percent") for v in (70, 71, 86)]) == ("low", "medium", "high")
    assert one(spark, scalar.clip(f(5.0), -1.0, 1.0), scalar.clip(f(-5.0), -1.0, 1.0)) == (1.0, -1.0)
    path = F.lit("/data/one_two_three_four_normal_traffic/file.csv")
    assert one(spark, scalar.folder_label(path), scalar.folder_label(F.lit("/data/a_b/file.csv"))) == ("normal_traffic", "")
    assert str(one(spark, scalar.from_epoch_seconds(f(1700000000.25)))[0]) == "2023-11-14 22:13:20.250000"


def test_log_lines(spark):
    lines = ["[2025-03-25 09:43:22] Honeypot accessed from 192.168.1.22", "[2025-03-25 09:43:22.5] Probe from 10.0.0.1", "broken"]
    df = spark.createDataFrame([(s,) for s in lines], "line string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in scalar.parse_log_line("line").items()]).collect()]
    assert str(got[0][0]) == "2025-03-25 09:43:22" and got[0][1:] == ("Honeypot accessed", "192.168.1.22")
    assert got[1][0].microsecond == 500000 and got[2] == (None, None, None)


def test_inverse_normal(spark):
    got = one(spark, *[scalar.inverse_normal(F.lit(p)) for p in (0.5, 0.975, 0.001, 0.999)])
    assert np.allclose(got, [0.0, 1.959963985, -3.090232306, 3.090232306], atol=1e-7)


def test_names(spark):
    assert names.sanitise(["Flow IAT Max", "flow IAT max", "cot=1", "Down/Up Ratio", "bw IAT std.1"]) == [
        "flow_iat_max", "flow_iat_max_2", "cot_1", "down_up_ratio", "bw_iat_std_1"]
    assert names.find_target(["src", "Attack Name", "Label"]) == "Label"
    assert names.find_target(["src", "my_attack"]) == "my_attack" and names.find_target(["a"]) is None
    assert names.fuzzy_column(["Src IP", "Labels"], "label") == "Labels" and names.fuzzy_column(["x"], "label") is None
    df = spark.createDataFrame([(1, 2, "a")], "x int, y int, z string")
    assert names.numeric_columns(df, ("y",)) == ["x"]
    doubled = df.select("x", F.col("y").alias("x"), "z")
    assert names.unique_columns(doubled).columns == ["x", "z"] and names.unique_columns(doubled).first()[0] == 1
    aligned = names.align(df, ["y", "missing"], keep=("z",))
    assert aligned.columns == ["z", "y", "missing"] and tuple(aligned.first()) == ("a", 2.0, 0.0)
    assert names.common_columns(df, aligned) == ["y", "z"]
    assert math.isclose(names.similarity("label", "labels"), 100 * 5 / 6)
