import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridlens.functions.frames import decode_frames, decode_packets, valid_frames
from gridlens.operators.rules import is_command, is_unknown_cause
from gridlens.sources import pcap
from gridlens.streaming import streams


# ---- frames -----------------------------------------------------------------------

def decoded(spark, *payloads):
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "id int, payload binary")
    return [r["frame"] for r in decode_frames(df).orderBy("id").collect()]


def test_frames(spark):
    head = bytes([0x68, 14, 0, 1, 2, 3])
    point, measured, control, wrong, cut, command, short = decoded(
        spark,
        head + bytes([1, 0x82, 3, 1, 2]) + bytes([0x01, 0x82]),
        head + bytes([9, 2, 44, 0xFF, 0xFF]) + struct.pack("<hB", -300, 7) + struct.pack("<hB", 32767, 255),
        head, b"\x69" + head[1:],
        head + bytes([9, 3, 3, 1, 0]) + struct.pack("<hB", 5, 1) + b"\x01\x02",
        bytes([0x68, 254, 0, 0, 0, 0, 45, 1, 6, 0, 0]), bytes([0x68, 4, 0]))
    assert (point.length, point.control, point.asdu.type, point.asdu.vsq, point.asdu.cot, point.asdu.addr) == (14, [0, 1, 2, 3], 1, 0x82, 3, 513)
    assert [tuple(o) for o in point.asdu.objects] == [(1, 0), (0, 65)]
    assert [tuple(o) for o in measured.asdu.objects] == [(-300, 7), (32767, 255)] and measured.asdu.addr == 65535
    assert control.asdu is None and wrong is None and short is None
    assert [tuple(o) for o in cut.asdu.objects] == [(5, 1)]
    assert command.length == 254 and command.asdu.objects == []


def test_valid_frames_are_the_decodable_ones(spark):
    df = spark.createDataFrame([(bytearray(p),) for p in (bytes([0x68, 4, 0, 0, 0, 0]), bytes([0x68, 4, 0]), b"\x69" * 8, b"")], "payload binary")
    assert valid_frames(df).count() == decode_frames(df).where("frame is not null").count() == 1


def test_frame_rules(spark):
    df = spark.createDataFrame([(45, 3), (1, 44), (1, 40), (48, 45)], "t int, c int")
    assert [tuple(r) for r in df.select(is_command("t"), is_unknown_cause("c")).collect()] == [
        (True, False), (False, True), (False, False), (False, False)]


# ---- captures ------------------------------------------------------------------------

def ethernet(src, dst, proto, body, vlan=False, options=0):
    number = lambda ip: bytes(int(p) for p in ip.split("."))
    ip = bytes([0x45 + options, 0]) + struct.pack(">H", 20 + 4 * options + len(body)) + bytes(5) + bytes([proto]) + bytes(2) + number(src) + number(dst)
    return b"\x01" * 6 + b"\x02" * 6 + (b"\x81\x00\x00\x05" if vlan else b"") + b"\x08\x00" + ip + bytes(4 * options) + body


def tcp(sport, dport, flags, data=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0) + data


def capture(records, order="<", nano=False, link=1):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for seconds, fraction, data in records:
        out += struct.pack(order + "IIII", seconds, fraction, len(data), len(data) + 1) + data
    return out


@pytest.mark.parametrize("order,nano", [("<", False), (">", False), ("<", True), (">", True)])
def test_capture_decode(spark, tmp_path, order, nano):
    scale = 1000 if nano else 1
    records = [
        (100, 5 * scale, ethernet("10.0.0.1", "10.0.0.2", 6, tcp(1234, 2404, 2, b"abc"))),
        (100, 6 * scale, ethernet("10.0.0.2", "10.0.0.1", 17, struct.pack(">HHHH", 53, 99, 8, 0) + b"xy", vlan=True)),
        (101, 0, b"\xff" * 6 + b"\x0a" * 6 + b"\x08\x06" + bytes(28)),
        (102, 0, ethernet("1.2.3.4", "5.6.7.8", 6, tcp(1, 2, 18), options=2)),
        (103, 0, b"\x01"),
    ]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.pcap").write_bytes(capture(records, order, nano))
    packets, files = pcap.read_captures(spark, str(tmp_path), split=40)  # every packet is its own range
    got = [tuple(r) for r in packets.orderBy("offset").select("ts_us", "src", "dst", "proto", "sport", "dport", "tcp_flags", "payload").collect()]
    assert got[0] == (100000005, "10.0.0.1", "10.0.0.2", 6, 1234, 2404, 2, bytearray(b"abc"))
    assert got[1] == (100000006, "10.0.0.2", "10.0.0.1", 17, 53, 99, None, bytearray(b"xy"))
    assert got[2][1:7] == ("0a:0a:0a:0a:0a:0a", "ff:ff:ff:ff:ff:ff", None, None, None, None)
    assert got[3][1:7] == ("1.2.3.4", "5.6.7.8", 6, 1, 2, 18) and len(got) == 5
    assert [r["status"] for r in files.collect()] == ["ok"]
    whole, _ = pcap.read_captures(spark, str(tmp_path))
    assert whole.count() == 5 and packets.agg(F.count_distinct("offset")).first()[0] == 5


def test_broken_captures(spark, tmp_path):
    good = capture([(1, 0, ethernet("1.1.1.1", "2.2.2.2", 6, tcp(1, 2, 2)))] * 3)
    (tmp_path / "cut.pcap").write_bytes(good[:-10])
    (tmp_path / "empty.pcap").write_bytes(b"\xd4\xc3")
    (tmp_path / "text.pcap").write_bytes(b"not a capture at all, really")
    (tmp_path / "wifi.pcap").write_bytes(capture([], link=105))
    (tmp_path / "none.pcap").write_bytes(capture([]))
    packets, files = pcap.read_captures(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["error"]) for r in files.collect()}
    assert got == {
        "cut.pcap": ("partial", "truncated record"), "empty.pcap": ("failed", "truncated header"), "text.pcap": ("failed", "no capture file"),
        "wifi.pcap": ("failed", "link type is not Ethernet"), "none.pcap": ("ok", None)}
    assert packets.count() == 2


def test_short_frames_do_not_fail(spark):
    full = ethernet("1.1.1.1", "2.2.2.2", 6, tcp(7, 8, 16))
    df = spark.createDataFrame([(n, bytearray(full[:n])) for n in range(0, len(full) + 1)], "n int, data binary")
    got = {r["n"]: r for r in decode_packets(df).collect()}
    assert got[33]["proto"] is None and got[34]["src"] == "1.1.1.1" and got[36]["sport"] is None
    assert got[38]["dport"] == 8 and got[47]["tcp_flags"] is None and got[48]["tcp_flags"] == 16


# ---- streams ----------------------------------------------------------------------------

START = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, s, START + timedelta(minutes=m), c) for i, s, m, c in rows], "event_id bigint, src string, ts timestamp_ntz, confidence double")


def land(spark, folder, batches):
    """One file per batch, read one at a time in order of their times."""
    import os
    import time

    for n, rows in enumerate(batches):
        path = f"{folder}/in/b{n}"
        events(spark, rows).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet"):
                os.utime(f"{path}/{f}", (time.time() - 1000 + n * 10,) * 2)
    return streams.packet_stream(spark, f"{folder}/in/*", events(spark, []).schema, files_per_batch=1)


def test_late_rows_are_dropped_and_in_time_rows_kept(spark, tmp_path, rows):
    stream = land(spark, tmp_path, [
        [(1, "a", 0, 0.1), (2, "a", 125, 0.1)],
        [(4, "a", 121, 0.1)],
        [(3, "a", 59, 0.1), (5, "b", 300, 0.1)],  # 59 min is before the watermark of 115 min: late
    ])
    streams.run_available(streams.source_counts(stream, "src"), f"{tmp_path}/cp", path=f"{tmp_path}/out")
    got = rows(spark.read.parquet(f"{tmp_path}/out").select(F.hour("window_start"), "src", "n"))
    assert got == [(0, "a", 1), (2, "a", 2)]


def test_repeats_within_the_watermark(spark, tmp_path, rows):
    stream = land(spark, tmp_path, [[(1, "a", 0, 0.1), (1, "a", 1, 0.1)], [(1, "a", 2, 0.2), (2, "a", 3, 0.1)]])
    streams.run_available(streams.without_repeats(stream, "event_id").select("event_id"), f"{tmp_path}/cp", path=f"{tmp_path}/out")
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [(1,), (2,)]


BATCHES = [
    [(1, "a", 0, 0.5), (2, "a", 5, 0.95), (3, "a", 6, 0.2), (4, "b", 1, 0.90)],
    [(5, "a", 7, 0.99), (6, "b", 2, 0.1), (7, "a", 4, 0.3)],
    [(8, "b", 9, 0.91), (9, "b", 10, 0.1), (10, "c", 1, 0.2)],
]
SCHEMA = "event_id bigint, src string, ts timestamp, confidence double"


def test_blocking_over_batches_equals_batch_rule(spark, tmp_path, rows):
    from gridlens.operators.rules import auto_block

    accepted, sink = streams.blocking_sink(f"{tmp_path}/out", "src", ["ts", "event_id"], "confidence", SCHEMA)
    streams.run_available(land(spark, tmp_path, BATCHES), f"{tmp_path}/cp", each=sink)
    got = rows(accepted.read(spark), "event_id", "blocks")
    every = events(spark, [r for b in BATCHES for r in b])
    assert got == rows(auto_block(every, "src", ["ts", "event_id"], "confidence"), "event_id", "blocks")
    assert [g for g in got if g[1]] == [(2, True), (8, True)]
    # A batch that is run again changes nothing.
    sink(events(spark, BATCHES[2]).withColumn("ts", F.col("ts").cast("timestamp")), 2)
    assert rows(accepted.read(spark), "event_id", "blocks") == got


def test_ring_buffer_keeps_the_latest(spark, tmp_path):
    table, sink = streams.ring_buffer(f"{tmp_path}/out", SCHEMA, ["ts", "event_id"], 3)
    streams.run_available(land(spark, tmp_path, BATCHES), f"{tmp_path}/cp", each=sink)
    last = table.read(spark).where("batch = 2").orderBy(F.desc("ts")).collect()
    assert [r["event_id"] for r in last] == [9, 8, 5]


def test_update_counters_and_alerts(spark, tmp_path, rows):
    stream = land(spark, tmp_path, BATCHES)
    table, sink = streams.upserted(f"{tmp_path}/out", "src string, n bigint")
    streams.run_available(stream.groupBy("src").count().withColumnRenamed("count", "n"), f"{tmp_path}/cp", "update", each=sink)
    assert rows(streams.newest(table, spark, ["src"])) == [("a", 5), ("b", 4), ("c", 1)]
    streams.run_available(streams.alerts(stream, F.col("confidence"), 0.5).select("event_id", "band"), f"{tmp_path}/cp2", path=f"{tmp_path}/alerts")
    assert rows(spark.read.parquet(f"{tmp_path}/alerts")) == [(2, "HIGH"), (4, "HIGH"), (5, "HIGH"), (8, "HIGH")]


def test_sessions_and_violations(spark, tmp_path, rows):
    stream = land(spark, tmp_path, [[(1, "a", 0, 0.1), (2, "a", 20, 0.9), (3, "a", 60, 0.9)], [(4, "z", 600, 0.1)]])
    streams.run_available(streams.session_counts(stream, "src"), f"{tmp_path}/cp", path=f"{tmp_path}/s")
    assert rows(spark.read.parquet(f"{tmp_path}/s").select("src", "n")) == [("a", 1), ("a", 2)]
    bad = F.col("confidence") > 0.5
    streams.run_available(streams.violation_rate(stream, bad, ~bad), f"{tmp_path}/cp2", path=f"{tmp_path}/v")
    assert rows(spark.read.parquet(f"{tmp_path}/v").select("n", "violations", "rate")) == [(1, 1, 1.0), (2, 1, 0.5)]
