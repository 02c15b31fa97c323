import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.operators import clean, encode, graph, joins, profile, rules, sampling, sequence
from gridlens.sources import tabular


# ---- sources -------------------------------------------------------------------

def test_folder_union_with_rejects_and_labels(spark, tmp_path, rows):
    for folder, text in (("a_b_c_d_normal", "id,v\n1,1.5\n2,bad\n"), ("a_b_c_d_replay_attack", "id,v\n3,2.5\n")):
        os.makedirs(tmp_path / folder)
        (tmp_path / folder / "part.csv").write_text(text)
    (tmp_path / "notes.txt").write_text("no table")
    good, bad = tabular.read_folder(spark, str(tmp_path), "id int, v double")
    assert rows(tabular.with_folder_label(good), "id", "attack_type") == [(1, "normal"), (3, "replay_attack")]
    assert rows(bad, "line") == [("2,bad",)]


def test_csv_inference_cleans_names(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Flow IAT Max,flow IAT max\n1,2\n")
    assert tabular.read_csv(spark, str(tmp_path / "t.csv")).columns == ["flow_iat_max", "flow_iat_max_2"]


# ---- cleaning, encoding ------------------------------------------------------------

def test_robust_clean(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, 1.0, None), (2, inf, None), (3, 3.0, None), (4, 1000.0, None)], "id int, a double, b double")
    out = clean.robust_clean(df, ["a", "b"], width=3).orderBy("id").collect()
    assert [r["b"] for r in out] == [0.0] * 4 and [r["pad_2"] for r in out] == [0.0] * 4
    filled = np.array([1.0, 3.0, 3.0, 1000.0])  # the median of 1, 3, 1000 fills the infinity
    q1, q3 = np.quantile(filled, [0.25, 0.75])
    assert np.allclose([r["a"] for r in out], np.clip(filled, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))


def test_fills(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (100.0,), (None,)], "v double")
    assert clean.fill_values(df, ["v"], "adaptive") == {"v": 1.5}  # skewed: the median
    even = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double")
    assert clean.fill_values(even, ["v"], "adaptive") == {"v": 2.0}
    tie = spark.createDataFrame([("b",), ("a",), (None,)], "v string")
    assert clean.fill_values(tie, ["v"], "mode") == {"v": "a"}
    assert [r[0] for r in clean.impute(even, ["v"], "constant", 9.0).collect()].count(9.0) == 1
    assert clean.drop_empty_columns(df.withColumn("n", F.lit(None).cast("int"))).columns == ["v"]


def test_downcast_types(spark):
    df = spark.createDataFrame([(1, 40000, 0.5, 0.1), (-2, 3, 2.0, 0.2)], "a bigint, b bigint, c double, d double")
    assert clean.downcast_types(df, ["a", "b", "c", "d"]) == {"a": "byte", "b": "int", "c": "float", "d": "double"}


def test_encode_round_trip_and_unknowns(spark, rows):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "id int, c string")
    codes = encode.dictionary(df, "c")
    coded = encode.encode_with(df, "c", codes, "k", missing=-1)
    assert rows(coded, "id", "k") == [(1, 1), (2, 0), (3, -1), (4, 1)]
    assert rows(encode.label_decode(coded, "k", codes, "back"), "id", "back") == [(1, "b"), (2, "a"), (3, None), (4, "b")]
    later = spark.createDataFrame([(5, "z"), (6, "a")], "id int, c string")
    assert rows(encode.one_hot(later, "c", ["a", "b"]), "id", "c_a", "c_b") == [(5, 0, 0), (6, 1, 0)]
    assert rows(encode.factorize(df, "c", "id", "f"), "id", "f") == [(1, 0), (2, 1), (3, -1), (4, 0)]
    with pytest.raises(ValueError):
        encode.categories(df, "c", limit=1)


def test_encoder_pipeline(spark):
    df = spark.createDataFrame([("a", f"v{i}") for i in range(12)] + [("b", "v0")], "few string, many string")
    assert encode.encoding_plan(df, ["few", "many"]) == {"few": "ordinal", "many": "onehot"}
    model = encode.encoder_pipeline(df, ["few", "many"]).fit(df)
    out = model.transform(spark.createDataFrame([("new", "new"), ("b", "v1")], "few string, many string")).collect()
    assert out[0]["few_index"] == 2.0 and out[1]["few_index"] == 1.0
    assert out[1]["many_onehot"].numNonzeros() == 1


def test_scaling_inverse_and_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    for method, want in (("minmax", [0.0, 1.0]), ("zscore", [-1.0, 1.0]), ("robust", [-1.0, 1.0])):
        params = encode.scale_params(df, ["a", "c"], method)
        scaled = encode.scale(df, params)
        assert sorted(r["a"] for r in scaled.collect()) == want and {r["c"] for r in scaled.collect()} == {0.0}
        assert sorted(r["a"] for r in encode.unscale(scaled, params).collect()) == [1.0, 3.0]


# ---- profile ------------------------------------------------------------------------

def test_binary_columns(spark):
    df = spark.createDataFrame([(0, 5, "x", 1), (1, 7, "x", None), (1, 7, "y", 2), (0, 5, "z", 2)], "a int, b int, c string, d int")
    assert profile.binary_columns(df) == ["a", "b", "d"] and profile.binary_columns(df, zero_one=True, columns=["a", "b"]) == ["a"]


def test_moments_match_hand_values(spark):
    x = np.array([1.0, 2.0, 4.0, 9.0, 11.0])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    row = profile.advanced_stats(df, ["v"]).first()
    n, m = len(x), x.mean()
    g1 = ((x - m) ** 3).mean() / ((x - m) ** 2).mean() ** 1.5
    assert np.isclose(row["skewness"], g1 * np.sqrt(n * (n - 1)) / (n - 2)) and np.isclose(row["std"], x.std(ddof=1))
    short = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert profile.advanced_stats(short, ["v"]).first()["skewness"] is None


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "a double, b double")
    found = {(r[0], r[1]): r[2] for r in profile.correlation_pairs(df, ["a", "b"]).collect()}
    assert found[("a", "a")] == 1.0 and found[("b", "b")] is None


def test_welch_finds_the_tone(spark):
    n = 2048
    df = spark.createDataFrame([(i, float(np.sin(2 * np.pi * 0.125 * i))) for i in range(n)], "id int, v double").repartition(6)
    out = profile.welch_density(df, ["id"], "v", segment=256)
    best = out.orderBy(F.desc("power")).first()
    assert best["frequency"] == 0.125 and best["n_segments"] == 15


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,), (None,)], "v double")
    got = {r["bin"]: r["n"] for r in profile.histogram(df, "v", 5).collect()}
    assert got == {0: 2, 1: 0, 2: 0, 3: 0, 4: 2}


# ---- rules -----------------------------------------------------------------------------

def test_cidr_against_brute_force(spark, rows):
    import ipaddress
    import random

    draw = random.Random(5)
    table = [(i, f"10.{draw.randrange(4)}.{draw.randrange(4) if b > 16 else 0}.0/{b}", draw.choice(["ALLOW", "BLOCK", "INSPECT"]), draw.random() < 0.8)
             for i, b in enumerate([16, 16, 24, 24, 24, 24, 16, 24])] + [(99, "0.0.0.0/0", "INSPECT", True), (98, "10.1.1.1/32", "BLOCK", True)]
    table = [(i, str(ipaddress.ip_network(c, strict=False)), a, e) for i, c, a, e in table]
    ips = [f"10.{draw.randrange(5)}.{draw.randrange(5)}.{draw.randrange(3)}" for _ in range(200)] + ["aa:bb"]
    got = rules.cidr_action(spark.createDataFrame([(i,) for i in ips], "ip string"), "ip",
                            spark.createDataFrame(table, "rule_id int, src_cidr string, action string, active boolean"))

    def expected(ip):
        if ":" in ip:
            return (ip, None, "ALLOW")
        hits = [(-ipaddress.ip_network(c).prefixlen, i, a) for i, c, a, e in table if e and ipaddress.ip_address(ip) in ipaddress.ip_network(c)]
        return (ip, min(hits)[1], min(hits)[2]) if hits else (ip, None, "ALLOW")

    assert rows(got, "ip", "rule_id", "action") == sorted((expected(i) for i in ips), key=repr)


def test_firewall_lists_of_unknown_size(spark, rows):
    df = spark.createDataFrame([("a", 2404), ("b", 2404), ("a", 80)], "src string, port int")
    black = spark.createDataFrame([("b",), ("b",)], "ip string")
    ports = spark.createDataFrame([(2404,)], "port int")
    assert rows(rules.firewall_check(df, "src", "port", black, ports)) == [("a", 2404, True), ("a", 80, False), ("b", 2404, False)]


def test_labels_and_violations(spark):
    df = spark.createDataFrame([(" Benign ", 253, 3), ("Replay Attack", 254, 2), ("odd", 1, 0)], "t string, length int, c int")
    got = df.select(rules.keyword_label("t"), rules.blocked_flag("t"), rules.binary_label("t", "benign"), rules.frame_violations("length", ["c"])).collect()
    assert [tuple(r) for r in got] == [(0, False, 0, []), (1, True, 1, ["apdu_length", "control_1"]), (1, True, 1, [])]


def test_vector_errors(spark):
    df = spark.createDataFrame([([1.0, 2.0], "m"), ([], "m"), (None, "m"), ([1.0, float("nan")], "m"), ([1.0], "m"), ([1.0, 2.0], "q")],
                               "x array<double>, model string")
    got = [r[0] for r in df.select(rules.vector_error("x", 2, "model", ("m",))).collect()]
    assert got == [None, "empty", "empty", "not_numeric", "width", "unknown_model"]


def test_auto_block_edges(spark, rows):
    df = spark.createDataFrame([(1, "a", 1, 0.90), (2, "a", 2, 0.91), (3, "a", 2, 0.99), (4, "a", 3, 0.1), (5, "b", 1, 0.2)],
                               "id int, src string, ts int, conf double")
    assert rows(rules.auto_block(df, "src", ["ts", "id"], "conf"), "id", "blocks") == [(1, False), (2, True), (5, False)]


# ---- joins and sequences -----------------------------------------------------------------

def test_packets_in_overlapping_lifetimes(spark, rows):
    draw = np.random.default_rng(4)
    packets = [(int(i), int(draw.integers(0, 3)), int(draw.integers(0, 60)), float(draw.integers(0, 9))) for i in range(150)]
    flows = [(int(i), int(draw.integers(0, 3)), int(s), int(s + draw.integers(0, 30))) for i, s in enumerate(draw.integers(0, 60, 20))]
    got = joins.packets_in_lifetime(
        spark.createDataFrame(packets, "id int, src int, t int, v double"), spark.createDataFrame(flows, "flow int, src int, s int, e int"),
        ["src"], "t", "v", "s", "e", "flow")
    want = []
    for f, src, s, e in flows:
        inside = [p for p in packets if p[1] == src and s <= p[2] <= e]
        want.append((src, f, len(inside), sum(p[3] for p in inside)))
    assert rows(got) == sorted(want, key=repr)


def test_flow_of_packet_bounds(spark, rows):
    packets = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "a", 20), (4, "a", 21), (5, "b", 10)], "pid int, src string, t int")
    flows = spark.createDataFrame([(7, "a", 10, 20)], "fid int, src string, s int, e int")
    got = joins.flow_of_packet(packets, flows, ["src"], "t", "pid", "s", "e", "fid")
    assert rows(got, "pid", "fid") == [(1, None), (2, 7), (3, 7), (4, None), (5, None)]


def test_syn_ack_pairing_rules(spark, rows):
    syn, ack, both = 2, 16, 18
    seq = [  # SYN, SYN, ACK: the later SYN counts; ACK alone; SYN-ACK renews; 0 and 1000 ms do not count but use up the SYN
        (1, "a", 0, syn), (2, "a", 100_000, syn), (3, "a", 150_000, ack), (4, "a", 160_000, ack),
        (5, "b", 0, syn), (6, "b", 20_000, both), (7, "b", 50_000, ack),
        (8, "c", 0, syn), (9, "c", 0, ack), (10, "c", 10_000, ack),
        (11, "d", 0, syn), (12, "d", 1_000_000, ack), (13, "d", 1_000_001, ack), (14, "d", 5, 8),
    ]
    df = spark.createDataFrame(seq, "id int, flow string, us bigint, flags int")
    assert rows(joins.syn_ack_pairs(df, ["flow"], ["us", "id"], "us", "flags"), "id", "rtt_ms") == [(3, 50.0), (7, 30.0)]


def packets(spark, seq):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, c, f, start + timedelta(milliseconds=ms), n) for i, (c, f, ms, n) in enumerate(seq)],
                                 "id int, cap string, flow string, ts timestamp_ntz, length int")


def test_capture_summary_edges(spark):
    df = packets(spark, [("one", "x", 0, 60), ("same", "x", 5, 60), ("same", "x", 5, 70), ("ok", "x", 0, 100), ("ok", "y", 1000, 100), ("ok", "x", 3000, 100)])
    got = {r["cap"]: r for r in sequence.capture_summary(df, ["cap"], "ts", "id", "length").collect()}
    assert set(got) == {"same", "ok"}
    assert got["same"]["bytes_per_s"] == 0.0 and got["same"]["packets_per_s"] == 0.0
    assert got["ok"]["iat_mean_ms"] == 1500.0 and got["ok"]["iat_std_ms"] == 500.0 and got["ok"]["bytes_per_s"] == 100.0
    more = {r["cap"]: r for r in sequence.capture_summary_extended(df, ["cap"], "ts", "id", "length", ["flow"]).collect()}
    assert more["ok"]["flow_count"] == 2 and more["same"]["flow_count"] == 1 and more["ok"]["iat_max_ms"] == 2000.0
    assert np.isclose(more["ok"]["mbps"], 300 * 8 / 3e6)


def test_burst_rules(spark):
    few = [("few", "x", i * 10, 1) for i in range(10)]  # nine gaps
    many = [("many", "xy"[i % 2], i * 50, 1) for i in range(11)] + [("many", "x", 501, 1)]  # ten of exactly 50 ms, one of 1 ms
    df = packets(spark, few + many)
    got = {r["cap"]: r for r in sequence.burst_intensity(df, ["cap"], "ts", "id").collect()}
    assert got["few"]["intensity"] == 0.0 and np.isclose(got["many"]["intensity"], 1 / 11)
    factor = {r["cap"]: r for r in sequence.burst_factor(df, ["cap"], "ts", "id", ["flow"]).collect()}
    assert factor["few"]["burst_factor"] == 0.0 and factor["few"]["propagation_ms"] == 0.0
    assert np.isclose(factor["many"]["propagation_ms"], 50.0) and np.isclose(factor["many"]["burst_factor"], 1 / 11)


def test_run_lengths_with_nulls(spark, rows):
    df = spark.createDataFrame(list(enumerate(["a", "a", None, None, "a", "b"])), "id int, v string")
    assert rows(sequence.run_lengths(df, ["id"], "v", "id"), "run", "value", "first_id", "length") == [
        (1, "a", 0, 2), (2, None, 2, 2), (3, "a", 4, 1), (4, "b", 5, 1)]


# ---- graphs ---------------------------------------------------------------------------------

def test_components_against_union_find(spark):
    draw = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 400, (220, 2))]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, n) for n in range(2001, 2200)] + [(5000, 5000)]  # chain, star, loop
    edges = graph.undirected_edges(spark.createDataFrame(pairs, "s int, d int"), "s", "d")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {tuple(r) for r in graph.components(edges).collect()} == {(x, find(x)) for x in list(parent)}


def test_degrees_count_loops_twice(spark, rows):
    edges = graph.undirected_edges(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), (None, "a")], "s string, d string"), "s", "d")
    assert rows(graph.degrees(edges)) == [("a", 1), ("b", 1), ("c", 2)]
    assert tuple(graph.graph_metrics(edges).first()) == (3, 2, 4 / 3, 4 / 6)
    assert graph.node_sample(edges.select(F.hash("a").alias("a"), F.hash("b").alias("b")), 2).count() <= 2


# ---- sampling ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 == 1, "mid").otherwise("common").alias("label"))


@pytest.mark.parametrize("bracket", [20_000, 15])
def test_exact_and_repeatable_samples(labelled, rows, monkeypatch, bracket):
    monkeypatch.setattr(sampling, "BRACKET", bracket)
    assert sampling.sample_rows(labelled, "id", 137).count() == 137
    assert sampling.sample_rows(labelled, "id", 5000).count() == 2000
    parted = sampling.split(labelled, "id", 0.15, "label").groupBy("label", "is_test").count()
    assert {r["label"]: r["count"] for r in parted.collect() if r["is_test"]} == {"rare": 30, "mid": 30, "common": 240}
    a, b = (rows(sampling.split(d, "id", 0.15, "label").where("is_test"), "id") for d in (labelled, labelled.repartition(9)))
    assert a == b


def test_undersample_weights_folds(labelled):
    kept = {r["label"]: r["count"] for r in sampling.undersample(labelled, "id", "label").groupBy("label").count().collect()}
    assert kept == {"rare": 200, "mid": 200, "common": 600}
    weights = sampling.class_weights(labelled, "label")
    assert np.isclose(weights["rare"], 2000 / (3 * 200)) and np.isclose(weights["common"], 2000 / (3 * 1600))
    folds = [r["count"] for r in sampling.with_fold(labelled, "id", 5).groupBy("fold").count().collect()]
    assert len(folds) == 5 and min(folds) > 300
    assert [r["id"] for r in sampling.systematic(labelled, ["id"], 500).orderBy("id").collect()] == [0, 500, 1000, 1500]


def test_donors_permute(spark, labelled):
    given = sampling.donors(labelled, "id", "id", 3, "donor").collect()
    assert sorted(r["donor"] for r in given) == list(range(2000)) and all(r["donor"] != r["id"] for r in given)


def test_wide_correlations_equal_pairwise_ones(spark, monkeypatch):
    from gridlens.operators import pairwise

    draw = np.random.default_rng(9)
    x = draw.normal(size=(300, 5)) @ draw.normal(size=(5, 5)) * np.array([1e6, 1, 1e-6, 1, 1]) + np.array([1e3, 1e3, 0, 1e3, 1e3])
    x[:, 4] = 7.0
    for holes in (False, True):
        rows = [[None if holes and draw.random() < 0.1 else float(v) for v in r] for r in x]
        df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(5))).repartition(4)
        columns = df.columns
        monkeypatch.setattr(pairwise, "NARROW", 12)
        want = pairwise.correlations(df, columns)
        monkeypatch.setattr(pairwise, "NARROW", 0)
        got = pairwise.correlations(df, columns)
        assert want.keys() == got.keys() and got[("c0", "c4")] is None
        assert all((want[p] is None) == (got[p] is None) and (want[p] is None or abs(want[p] - got[p]) < 1e-9) for p in want)
