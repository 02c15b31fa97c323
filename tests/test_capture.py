"""The capture source: borders of byte ranges, broken and huge records, the block format, IPv6, streams."""

import ipaddress
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from gridlens.functions.frames import decode_packets
from gridlens.sources import capture, pcap
from gridlens.streaming import streams
from tests.test_live import ethernet, tcp

SECOND = 1_700_000_000


def ipv6(src, dst, chain, body):
    """An Ethernet frame of IPv6 with extension headers (number, bytes)."""
    numbers = [n for n, _ in chain]
    parts = b"".join(bytes([numbers[i + 1]]) + x for i, (_, x) in enumerate(chain[:-1]))
    payload = parts + body
    head = bytes([0x60, 0, 0, 0]) + struct.pack(">HBB", len(payload), numbers[0], 64)
    return b"\x01" * 6 + b"\x02" * 6 + b"\x86\xdd" + head + ipaddress.IPv6Address(src).packed + ipaddress.IPv6Address(dst).packed + payload


def record(i, data, second=SECOND):
    return struct.pack("<IIII", second + i, i % 1_000_000, len(data), len(data)) + data


def head(snap=65535):
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snap, 1)


def packet(rng, more=0):
    body = rng.randbytes(rng.randint(1, 200))
    return ethernet("10.0.0.%d" % rng.randint(1, 9), "10.0.0.2", 6, tcp(rng.randint(1, 65535), 2404, 2, body)) + rng.randbytes(more)


def read(spark, folder, split):
    found, files = pcap.read_captures(spark, str(folder), split=split)
    rows = sorted((r.path.rsplit("/", 1)[1], r.offset, r.ts_us, bytes(r.data)) for r in found.select("path", "offset", "ts_us", "data").collect())
    return rows, {r.path.rsplit("/", 1)[1]: (r.status, r.error) for r in files.collect()}


def plain(name, data):
    """From end to end."""
    at, out = 24, []
    while at < len(data):
        seconds, fraction, size, _ = struct.unpack_from("<IIII", data, at)
        out.append((name, at, seconds * 1_000_000 + fraction, data[at + 16: at + 16 + size]))
        at += 16 + size
    return out


def test_ranges_give_what_one_reader_gives(spark, tmp_path):
    rng = random.Random(1)
    many = head() + b"".join(record(i, packet(rng)) for i in range(400))
    inside = head() + b"".join(record(i, ethernet("1.1.1.1", "2.2.2.2", 17, struct.pack(">HHHH", 1, 2, 0, 0) + many[24: 24 + 2500])) for i in range(40))  # captures as payload
    (tmp_path / "many.pcap").write_bytes(many)
    (tmp_path / "inside.pcap").write_bytes(inside)
    want = sorted(plain("many.pcap", many) + plain("inside.pcap", inside))
    for split in (6000, 1 << 20):
        rows, files = read(spark, tmp_path, split)
        assert rows == want and set(files.values()) == {("ok", None)}


def test_a_huge_record_and_a_broken_middle(spark, tmp_path):
    rng = random.Random(2)
    first, second, third = ([record(i, packet(rng)) for i in range(60)] for _ in range(3))
    huge = record(61, packet(rng, 20 << 20))
    good = head(1 << 26) + b"".join(first) + huge + b"".join(second)
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "huge.pcap").write_bytes(good)
    broken = head() + b"".join(first) + bytes(3000) + b"\xff" * 2000 + b"".join(second) + struct.pack("<IIII", SECOND, 5, 1 << 31, 9) + b"".join(third)
    (tmp_path / "b" / "broken.pcap").write_bytes(broken)
    (tmp_path / "b" / "cut.pcap").write_bytes(head() + b"".join(first)[:-3])
    rows, files = read(spark, tmp_path, 4 << 20)
    assert [r for r in rows if r[0] == "huge.pcap"] == plain("huge.pcap", good)
    kept = [r[3] for r in rows if r[0] == "broken.pcap"]
    assert kept == [x[16:] for x in [*first, *second, *third]]
    assert len([r for r in rows if r[0] == "cut.pcap"]) == 59
    assert files == {"huge.pcap": ("ok", None), "broken.pcap": ("partial", "bad record"), "cut.pcap": ("partial", "truncated record")}
    assert read(spark, tmp_path / "b", 6000)[0] == [r for r in rows if r[0] != "huge.pcap"]


def block(kind, body, order="<"):
    body += bytes(-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def section(order="<"):
    return block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)


def interface(order="<", link=1, unit=None, offset=None):
    options = b"" if unit is None else struct.pack(order + "HHB3x", 9, 1, unit)
    options += b"" if offset is None else struct.pack(order + "HHq", 14, 8, offset)
    return block(1, struct.pack(order + "HHI", link, 0, 0) + options + (struct.pack(order + "HH", 0, 0) if options else b""), order)


def enhanced(number, ticks, data, order="<"):
    return block(6, struct.pack(order + "IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data) + 3) + data, order)


@pytest.mark.parametrize("order", ["<", ">"])
def test_block_format(spark, tmp_path, order):
    rng = random.Random(3)
    x = [packet(rng) for _ in range(6)]
    data = section(order) + interface(order) + interface(order, unit=9, offset=100) + interface(order, link=113) + interface(order, unit=0x80 | 10)
    data += enhanced(0, SECOND * 1_000_000 + 7, x[0], order) + block(5, b"statistics..", order) + enhanced(1, SECOND * 10**9 + 8000, x[1], order)
    data += enhanced(2, 5, b"other link type", order) + enhanced(3, 3 << 10, x[2], order) + block(3, struct.pack(order + "I", len(x[3])) + x[3], order)
    data += b"\xee" * 400 + enhanced(0, 9, x[4], order) + section("<") + interface("<") + enhanced(0, 11, x[5])
    (tmp_path / "a.pcapng").write_bytes(data)
    for split in (200, 1 << 20):
        rows, files = read(spark, tmp_path, split)
        assert [r[2:] for r in rows] == [(SECOND * 1_000_000 + 7, x[0]), ((SECOND + 100) * 1_000_000 + 8, x[1]), (3_000_000, x[2]), (None, x[3]), (9, x[4]), (11, x[5])]
        assert files == {"a.pcapng": ("partial", "link type is not Ethernet")}


def test_ipv6(spark):
    body = struct.pack(">HHHH", 5353, 53, 8, 0) + b"hello"
    addresses = ["::", "::1", "fe80::", "2001:db8::1", "2001:db8:0:1:1:1:1:1", "1:0:0:2::3", "ff02::1:ff00:1", "1:2:3:4:5:6:7:8", "::ffff:a00:1", "a:0:0:1:0:0:0:b"]
    frames = [ipv6(a, "fe80::1", [(17, b"")], body) for a in addresses]
    options, fragment, later = bytes([0]) + bytes(6), struct.pack(">BHI", 0, 1, 9), struct.pack(">BHI", 0, 8 << 3, 9)
    frames += [ipv6("::1", "::2", [(0, options), (60, bytes([1]) + bytes(14)), (44, fragment), (6, b"")], tcp(7, 8, 18, b"abc")), ipv6("::1", "::2", [(44, later), (17, b"")], body)]
    frames += [ipv6("::1", "::2", [(58, b"")], b"ping"), frames[0][:40]]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(frames)], "i int, data binary")
    got = decode_packets(df).orderBy("i").collect()
    assert [r.src for r in got[:10]] == [str(ipaddress.IPv6Address(a)) if "ffff" not in a else "::ffff:a00:1" for a in addresses]
    assert {(r.dst, r.proto, r.sport, r.dport, bytes(r.payload)) for r in got[:10]} == {("fe80::1", 17, 5353, 53, b"hello")}
    assert (got[10].proto, got[10].sport, got[10].dport, got[10].tcp_flags, bytes(got[10].payload)) == (6, 7, 8, 18, b"abc")
    assert (got[11].proto, got[11].sport, got[11].payload) == (17, None, None)
    assert (got[12].proto, got[12].sport) == (58, None) and got[13].src == "02:02:02:02:02:02"


def test_files_that_cannot_be_read_are_rejects(spark, tmp_path, monkeypatch):
    (tmp_path / "gone.pcap").write_bytes(head())
    source = capture.CaptureReader({"path": str(tmp_path)})
    (part,) = source.partitions()
    os.remove(tmp_path / "gone.pcap")
    (batch,) = source.read(part)
    assert batch.to_pylist()[0]["status"] == "failed" and "gone.pcap" in batch.to_pylist()[0]["error"]


def test_a_stream_takes_each_file_once(spark, tmp_path):
    rng = random.Random(4)
    (tmp_path / "in").mkdir()
    stream = pcap.packet_stream(spark, str(tmp_path / "in")).select("path", "offset", "src", "sport")
    for i in range(2):
        (tmp_path / "in" / f"{i}.pcap").write_bytes(head() + b"".join(record(k, packet(rng)) for k in range(5 + i)))
        streams.run_available(stream, f"{tmp_path}/checkpoint", path=f"{tmp_path}/out")
    rows = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
    assert {(r.path.rsplit("/", 1)[1], r.n) for r in rows.groupBy("path").agg(F.count("*").alias("n")).collect()} == {("0.pcap", 5), ("1.pcap", 6)}
