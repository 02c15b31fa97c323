"""Capture files, protocol frames and streams, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions.frames import decode_frames, valid_frames
from gridlens.operators import models
from gridlens.operators.rules import is_command, is_unknown_cause
from gridlens.plans.common import PACKETS_SQL, event_alerts, packets, rounded
from gridlens.plans.registry import query
from gridlens.session import cut_lineage, scratch
from gridlens.sources import pcap
from gridlens.streaming import keyed, serving, streams


def _hex(c, digits):
    return F.lpad(F.hex(c), digits, "0")


def _ip_hex(ip):
    parts = F.split(ip, r"\.")
    return F.concat(*[_hex(parts[i].cast("bigint"), 2) for i in range(4)])


def _ethernet():
    """Ethernet, IPv4 and TCP bytes of a packet with its id as payload."""
    zeros = lambda n: F.lit("00" * n)
    return F.unhex(F.concat(
        F.lit("0A0000000001" "0A0000000002" "0800"),
        F.lit("4500"), _hex(F.lit(48), 4), zeros(4), F.lit("4006"), zeros(2), _ip_hex(F.col("src")), _ip_hex(F.col("dst")),
        _hex("sport", 4), _hex("dport", 4), zeros(8), F.lit("50"), _hex("flags", 2), zeros(6), _hex("packet_id", 16),
    ))


def _writers(t):
    """Tasks that write captures: as many as can run, so that files don't grow with the table alone."""
    return max(4, 2 * t.spark.sparkContext.defaultParallelism)


def _write_captures(t, folder):
    """Write the packets of each event type as capture files, one per task and type; those of type error get a broken start."""
    rows = packets(t.events).withColumn("data", _ethernet()).select("event_type", "ts_us", "packet_id", "length", "data")
    spread = rows.repartitionByRange(_writers(t), "event_type", "ts_us", "packet_id").sortWithinPartitions("event_type", "ts_us", "packet_id")

    def write(batches):
        import struct

        import pandas as pd
        from pyspark import TaskContext

        task, kind, out, files = TaskContext.get().partitionId(), None, None, 0
        for b in batches:
            for now, group in b.groupby("event_type", sort=False):
                if now != kind:  # rows are sorted: a type's rows of this task follow each other
                    if out:
                        out.close()
                    out, kind, files = pcap.create(f"{folder}/{now}-{task}.pcap"), now, files + 1
                    out.write((b"\x00\x00\x00\x00" if kind == "error" else b"\xd4\xc3\xb2\xa1") + struct.pack("<HHiIII", 2, 4, 0, 0, 65535, 1))
                for us, length, data in zip(group["ts_us"], group["length"], group["data"]):
                    out.write(struct.pack("<IIII", us // 1000000, us % 1000000, len(data), length) + data)
        if out:
            out.close()
        yield pd.DataFrame({"n": [files]})

    return spread.mapInPandas(write, "n int").agg(F.sum("n")).first()[0]


@query("pcap_packets", f"""
WITH {PACKETS_SQL} SELECT packet_id, ts, src, dst, 6 AS proto, sport, dport, flags AS tcp_flags, CAST(length AS BIGINT) AS length FROM packets WHERE event_type <> 'error'""")
def _(t):
    folder = scratch(t.spark, "captures")
    _write_captures(t, folder)
    found, _ = pcap.read_captures(t.spark, folder)
    packet_id = F.conv(F.hex("payload"), 16, 10).cast("bigint")
    return found.select(packet_id.alias("packet_id"), "ts", "src", "dst", "proto", "sport", "dport", "tcp_flags", "length")


@query("pcap_rejects", """
SELECT DISTINCT event_type AS capture, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN event_type = 'error' THEN 'no capture file' END AS error FROM events""")
def _(t):
    folder = scratch(t.spark, "captures")
    _write_captures(t, folder)
    _, files = pcap.read_captures(t.spark, folder)
    return files.select(F.regexp_extract("path", r"([^/]+)-\d+\.pcap$", 1).alias("capture"), "status", "error").distinct()


def _ethernet_ipv6():
    """Ethernet, IPv6 and UDP bytes of a packet behind one hop-by-hop header, with its id as payload."""
    zeros = lambda n: F.lit("00" * n)
    return F.unhex(F.concat(
        F.lit("0A0000000001" "0A0000000002" "86DD"), F.lit("60000000"), _hex(F.lit(24), 4), F.lit("0040"),
        F.lit("FD00"), zeros(10), F.lit("0001"), _hex(F.pmod("user_id", F.lit(65536)), 4), F.lit("FD00"), zeros(13), F.lit("09"),
        F.lit("1100"), zeros(6), _hex("sport", 4), _hex("dport", 4), _hex(F.lit(16), 4), zeros(2), _hex("packet_id", 16)))


def _write_mixed(t, folder):
    """Captures of IPv6 packets, of both formats by the event type, with broken parts between and, in those of the first and the last task, one record of 20 MB."""
    tasks = _writers(t)
    rows = packets(t.events).withColumn("data", _ethernet_ipv6()).select("event_type", "ts_us", "packet_id", "length", "data")
    spread = rows.repartitionByRange(tasks, "event_type", "ts_us", "packet_id").sortWithinPartitions("event_type", "ts_us", "packet_id")

    def write(batches):
        import struct

        import pandas as pd
        from pyspark import TaskContext

        def record(kind, us, length, data):
            if kind != "click":
                return struct.pack("<IIII", us // 1000000, us % 1000000, len(data), length) + data
            body = struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(data), length) + data + bytes(-len(data) % 4)
            return struct.pack("<II", 6, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

        section = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28) + struct.pack("<IIHHII", 1, 20, 1, 0, 0, 20)
        starts = {"click": section}
        task, written = TaskContext.get().partitionId(), {}
        for b in batches:
            for kind, group in b.groupby("event_type", sort=False):
                begins = kind not in written
                if begins:
                    out = written[kind] = pcap.create(f"{folder}/{kind}-{task}.{'pcapng' if kind == 'click' else 'pcap'}")
                    out.write(starts.get(kind, struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 26, 1)))
                out = written[kind]
                for i, (us, length, data) in enumerate(zip(group["ts_us"], group["length"], group["data"])):
                    out.write(record(kind, us, length, data))
                    if i == len(group) // 2:
                        out.write(b"\xee" * 5000)
                        if begins and task in (0, tasks - 1):
                            out.write(record(kind, us, 20 << 20, b"\x02" * 12 + b"\x88\xb5" + bytes(20 << 20)))
        for out in written.values():
            out.close()
        yield pd.DataFrame({"n": [len(written)]})

    return spread.mapInPandas(write, "n int").agg(F.sum("n")).first()[0]


@query("pcap_mixed", f"""
WITH {PACKETS_SQL} SELECT packet_id, ts, 'fd00::1:' || lower(to_hex(user_id % 65536)) AS src, 'fd00::9' AS dst, 17 AS proto, sport, dport, CAST(length AS BIGINT) AS length FROM packets""")
def _(t):
    folder = scratch(t.spark, "captures")
    _write_mixed(t, folder)
    found, _ = pcap.read_captures(t.spark, folder)
    packet_id = F.conv(F.hex("payload"), 16, 10).cast("bigint")
    return found.where("proto = 17").select(packet_id.alias("packet_id"), "ts", "src", "dst", "proto", "sport", "dport", "length")


# Frames: type by the id, two objects whose values come from the payload number.
FRAMES_SQL = """f AS (SELECT event_id, ([1, 9, 45, 30])[CAST(event_id % 4 AS INTEGER) + 1] AS type, CAST(props->>'$.k' AS INTEGER) AS k, CAST(user_id % 48 AS INTEGER) AS cot FROM events WHERE event_id % 5 <> 0)"""


def _frames(t):
    kind = F.element_at(F.array(*[F.lit(v) for v in (1, 9, 45, 30)]), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    k = F.get_json_object("props", "$.k").cast("int")
    start = F.when(F.col("event_id") % 5 == 0, F.lit("00")).otherwise(F.lit("68"))
    # Measured values are k - 50 as little-endian 16-bit numbers, which also covers negative ones.
    low = lambda v: F.concat(_hex(F.pmod(v, F.lit(256)), 2), _hex(F.pmod(F.floor(v / 256).cast("int"), F.lit(256)), 2))
    objects = F.when(kind == 9, F.concat(low(k - 50), F.lit("07"), low(k), F.lit("01"))).otherwise(F.concat(_hex(k, 2), _hex(k + 1, 2)))
    bytes_ = F.concat(start, F.lit("0E" "00000000"), _hex(kind, 2), F.lit("82"), _hex(F.pmod("user_id", F.lit(48)), 2), F.lit("0102"), objects)
    # Frames arrive as a table of bytes; written once, they are not built again for every test of a byte.
    return cut_lineage(t.events.select("event_id", F.unhex(bytes_).alias("payload")))


@query("frame_decode", f"""
WITH {FRAMES_SQL} SELECT event_id, type, 130 AS vsq, cot, 513 AS addr,
  CASE WHEN type = 1 THEN 2 WHEN type = 9 THEN 2 ELSE 0 END AS n_objects,
  CASE WHEN type = 1 THEN k % 2 WHEN type = 9 THEN k - 50 END AS first_value,
  CASE WHEN type = 1 THEN k // 2 WHEN type = 9 THEN 7 END AS first_quality FROM f""")
def _(t):
    found = decode_frames(valid_frames(_frames(t)))
    first = F.try_element_at(F.col("frame.asdu.objects"), F.lit(1))
    return found.select("event_id", "frame.asdu.type", "frame.asdu.vsq", "frame.asdu.cot", "frame.asdu.addr",
                        F.size("frame.asdu.objects").alias("n_objects"), first["value"].alias("first_value"), first["quality"].alias("first_quality"))


@query("frame_rules", f"""
WITH {FRAMES_SQL} SELECT event_id, type IN (45, 46, 47) AS is_command, cot IN (41, 42, 43, 44) AS is_unknown_cause FROM f WHERE type IN (45, 46, 47) OR cot IN (41, 42, 43, 44)""")
def _(t):
    found = decode_frames(valid_frames(_frames(t)))
    command, cause = is_command("frame.asdu.type"), is_unknown_cause("frame.asdu.cot")
    flagged = found.select("event_id", command.alias("is_command"), cause.alias("is_unknown_cause"))
    return flagged.where("is_command OR is_unknown_cause")


# ---- streams over the events file ------------------------------------------------------------

def _stream(t, delay=streams.DELAY):
    return streams.packet_stream(t.spark, t.folder, t.events.schema, "events.parquet", delay=delay)


@query("stream_counts", """
SELECT date_trunc('hour', ts) AS window_start, user_id, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t):
    path = scratch(t.spark, "stream")
    table, sink = streams.upserted(f"{path}/out", "window_start timestamp, window_end timestamp, user_id bigint, n bigint")
    streams.run_available(streams.source_counts(_stream(t), "user_id"), f"{path}/checkpoint", "update", each=sink)
    return streams.newest(table, t.spark, ["window_start", "user_id"]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "n")


@query("stream_source_totals", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def _(t):
    path = scratch(t.spark, "stream")
    table, sink = streams.upserted(f"{path}/out", "user_id bigint, n bigint")
    counts = _stream(t, delay=None).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    streams.run_available(counts, f"{path}/checkpoint", "update", each=sink)
    return streams.newest(table, t.spark, ["user_id"])


@query("stream_violations", """
SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, CAST(sum(CAST(event_type = 'error' AS INTEGER)) AS BIGINT) AS violations,
  round(avg(CAST(event_type = 'error' AS INTEGER)), 6) AS rate, round(avg(CAST((event_type = 'error') = (value > 80) AS INTEGER)), 6) AS accuracy FROM events GROUP BY 1""")
def _(t):
    path = scratch(t.spark, "stream")
    bad = F.col("event_type") == "error"
    found = streams.violation_rate(_stream(t), bad, bad == (F.col("value") > 80))
    table, sink = streams.upserted(f"{path}/out", "window_start timestamp, n bigint, violations bigint, rate double, accuracy double")
    streams.run_available(found, f"{path}/checkpoint", "update", each=sink)
    rows = streams.newest(table, t.spark, ["window_start"])
    return rounded(rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), ["rate", "accuracy"], 6)


@query("stream_alerts", """
SELECT event_id, CAST(props->>'$.k' AS INTEGER) / 100.0::DOUBLE AS confidence, CASE WHEN CAST(props->>'$.k' AS INTEGER) > 85 THEN 'HIGH' ELSE 'MEDIUM' END AS band
FROM events WHERE CAST(props->>'$.k' AS INTEGER) > 50""")
def _(t):
    path = scratch(t.spark, "stream")
    found = streams.alerts(_stream(t, delay=None), F.get_json_object("props", "$.k").cast("int") / 100.0).select("event_id", "confidence", "band")
    streams.run_available(found, f"{path}/checkpoint", path=f"{path}/out")
    return t.spark.read.schema("event_id bigint, confidence double, band string").parquet(f"{path}/out")


def _measured(events):
    """Requests of two numbers (one only for type error) and the band of the second one as their class."""
    k = F.get_json_object("props", "$.k").cast("double")
    x = F.when(F.col("event_type") == "error", F.array(k)).otherwise(F.array(F.col("value").cast("double"), k))
    return events.select("event_id", x.alias("x"), F.floor(k / 34).cast("int").alias("band"))


@query("stream_model_scores", """
SELECT event_id, 1 AS version, CASE WHEN event_type = 'error' THEN 'width' END AS reject,
  CASE WHEN event_type <> 'error' THEN (['low', 'middle', 'high'])[CAST(floor(CAST(props->>'$.k' AS INTEGER) / 34) AS INTEGER) + 1] END AS predicted,
  CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE END AS confidence FROM events""")
def _(t):
    # The bands follow from the second number, so a tree with a bin per value finds them exactly.
    path = scratch(t.spark, "serving")
    known = _measured(t.events).where("size(x) = 2").select(F.col("x")[0].alias("value"), F.col("x")[1].alias("k"), "band")
    store = serving.ModelStore(t.spark, f"{path}/models")
    store.publish(models.fit_pipeline("tree", known, ["value", "k"], "band", 3, maxBins=128), ["value", "k"], ["low", "middle", "high"])
    stream = _measured(_stream(t, delay=None)).drop("band")
    table, each = serving.scoring_sink(store, path, "x", stream.schema)
    streams.run_available(stream, f"{path}/checkpoint", each=each)
    return table.read(t.spark).select("event_id", "version", "reject", "predicted", "confidence")


@query("stream_auto_block", """
WITH a AS (SELECT event_id, user_id, ts, CAST(props->>'$.k' AS INTEGER) / 100.0::DOUBLE AS confidence FROM events),
b AS (SELECT user_id, min(ts) AS block_ts FROM a WHERE confidence > 0.9 GROUP BY user_id)
SELECT event_id, a.user_id, coalesce(ts = block_ts, false) AS blocks FROM a LEFT JOIN b ON b.user_id = a.user_id WHERE block_ts IS NULL OR ts <= block_ts""")
def _(t):
    return _accepted(t, None, None)


@query("stream_block_expiry", """
WITH RECURSIVE a AS (SELECT event_id, user_id, ts, CAST(props->>'$.k' AS INTEGER) / 100.0::DOUBLE AS confidence FROM events),
alert AS (SELECT * FROM a WHERE confidence > 0.9),
block AS (
  SELECT user_id, min(row(ts, event_id)) AS p FROM alert GROUP BY user_id
  UNION ALL
  SELECT b.user_id, (SELECT min(row(x.ts, x.event_id)) FROM alert x WHERE x.user_id = b.user_id AND x.ts >= b.p[1] + INTERVAL '2 hours') AS p
  FROM block b WHERE b.p IS NOT NULL)
SELECT event_id, a.user_id, EXISTS (SELECT 1 FROM block b WHERE b.user_id = a.user_id AND b.p = row(a.ts, a.event_id)) AS blocks FROM a
WHERE NOT EXISTS (SELECT 1 FROM block b WHERE b.user_id = a.user_id AND row(a.ts, a.event_id) > b.p AND a.ts < b.p[1] + INTERVAL '2 hours')""")
def _(t):
    return _accepted(t, 7200, streams.DELAY)


def _accepted(t, block_s, delay):
    path = scratch(t.spark, "stream")
    rows = event_alerts(_stream(t, delay)).select("event_id", "user_id", "ts", "confidence")
    found = keyed.blocked(rows, "user_id", "ts", "event_id", "confidence", block_s=block_s)
    streams.run_available(found, f"{path}/checkpoint", path=f"{path}/out")
    return t.spark.read.schema(found.schema).parquet(f"{path}/out").select("event_id", "user_id", "blocks")


@query("stream_recent", "SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(t):
    return _latest(t, 100, None)


@query("stream_recent_by_source", "SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def _(t):
    return _latest(t, 5, ["user_id"])


def _latest(t, n, by):
    path, order = scratch(t.spark, "stream"), ["ts", "event_id"]
    found = keyed.ring(_stream(t, delay=None).select("event_id", "user_id", "ts"), order, n, by)
    streams.run_available(found, f"{path}/checkpoint", path=f"{path}/out")
    rows = keyed.latest(t.spark.read.schema(found.schema).parquet(f"{path}/out"), order, n, by)
    return rows.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_sessions", """
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
r AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM n GROUP BY user_id, session)
SELECT *, session_end < (SELECT max(ts) FROM events) - INTERVAL '10 minutes' AS closed FROM r""")
def _(t):
    path = scratch(t.spark, "stream")
    found = keyed.sessions(_stream(t), "user_id", "ts", 1800)
    streams.run_available(found, f"{path}/checkpoint", path=f"{path}/out")
    closed = t.spark.read.schema(found.schema).parquet(f"{path}/out").withColumn("closed", F.lit(True))
    rows = closed.unionByName(keyed.open_sessions(t.spark, f"{path}/checkpoint", "user_id").withColumn("closed", F.lit(False)))
    at = lambda us: F.timestamp_micros(us).cast("timestamp_ntz")
    return rows.select("user_id", at(F.col("first")).alias("session_start"), at(F.col("last") + 1_800_000_000).alias("session_end"), "n", "closed")


@query("stream_distinct", "SELECT event_id FROM events")
def _(t):
    path = scratch(t.spark, "stream")
    streams.run_available(streams.without_repeats(_stream(t), "event_id").select("event_id"), f"{path}/checkpoint", path=f"{path}/out")
    return t.spark.read.schema("event_id bigint").parquet(f"{path}/out")
