"""Decoding of packets and telecontrol frames as column expressions over binary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the telecontrol frame format (IEC 60870-5-104).
START_BYTE = 0x68
SINGLE_POINT_TYPES = (1, 3, 5)
MEASURED_TYPES = (9, 11, 13)
# Fixed values of Ethernet and of both IP versions; extension headers of IPv6 with their length in the second byte, and the one of 8 bytes.
TYPE_IPV4, TYPE_IPV6, TYPE_VLAN, PROTO_TCP, PROTO_UDP = 0x0800, 0x86DD, 0x8100, 6, 17
EXTENSIONS, FRAGMENT = (0, 43, 60, 135), 44
#: Extension headers that are stepped over.
EXTENSION_DEPTH = 4


def _number(hexed: Column, at: Column | int, count: int = 1) -> Column:
    """Big-endian number of ``count`` bytes at a 0-based byte position of hex text."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substring(hexed, at * 2 + 1, F.lit(count * 2)), 16, 10).cast("bigint")


def _byte(hexed: Column, at: Column | int) -> Column:
    return _number(hexed, at).cast("int")


def decode_frames(df: DataFrame, payload: str = "payload", name: str = "frame") -> DataFrame:
    """Add the decoded frame, or null where the start byte is wrong or the control part is cut off.

    struct<length, control: array<int>, asdu: struct<type, vsq, cot, addr, objects: array<struct<value, quality>>>>;
    ``asdu`` is null for control-only frames, and objects that do not fit the data are left out.
    """
    # Header bytes are columns of their own, so that each is taken from the hex text once.
    header = {"__start": 0, "__length": 1, "__c1": 2, "__c2": 3, "__c3": 4, "__c4": 5, "__type": 6, "__vsq": 7, "__cot": 8, "__low": 9, "__high": 10}
    step = df.withColumn("__hex", F.hex(payload)).select("*", *[_byte(F.col("__hex"), at).alias(n) for n, at in header.items()])
    hexed, type_id = F.col("__hex"), F.col("__type")
    size, announced = F.length(payload), F.col("__vsq").bitwiseAND(0x7F)
    is_single, is_measured = type_id.isin(*SINGLE_POINT_TYPES), type_id.isin(*MEASURED_TYPES)
    fits = F.when(is_single, F.least(announced, size - 11)).when(is_measured, F.least(announced, F.floor((size - 11) / 3).cast("int"))).otherwise(0)
    step = step.withColumn("__count", fits)

    def single(i: Column) -> Column:
        b = _byte(hexed, i + 11)
        return F.struct(b.bitwiseAND(1).alias("value"), F.shiftright(b, 1).alias("quality"))

    def measured(i: Column) -> Column:
        # Two bytes with the low one first, read as a signed 16-bit number.
        raw = F.pmod(_byte(hexed, i * 3 + 11) + _byte(hexed, i * 3 + 12) * 256 + 32768, F.lit(65536)) - 32768
        return F.struct(raw.alias("value"), _byte(hexed, i * 3 + 13).alias("quality"))

    places = F.when(F.col("__count") > 0, F.sequence(F.lit(0), F.col("__count") - 1)).otherwise(F.array().cast("array<int>"))
    objects = F.when(is_single, F.transform(places, single)).otherwise(F.transform(places, measured))
    asdu = F.when(size >= 11, F.struct(
        type_id.alias("type"), F.col("__vsq").alias("vsq"), F.col("__cot").alias("cot"),
        (F.col("__low") + F.col("__high") * 256).alias("addr"), objects.alias("objects")))
    frame = F.when((size >= 6) & (F.col("__start") == START_BYTE), F.struct(
        F.col("__length").alias("length"), F.array("__c1", "__c2", "__c3", "__c4").alias("control"), asdu.alias("asdu")))
    return step.select(*df.columns, frame.alias(name))


def valid_frames(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows that :func:`decode_frames` can decode. A test of two bytes, where a test of the decoded frame would decode twice."""
    return df.where((F.length(payload) >= 6) & (F.hex(F.substring(payload, 1, 1)) == f"{START_BYTE:02X}"))


def _groups(hexed: Column) -> Column:
    """The eight groups of an address of 32 hex digits, without leading zeros."""
    return F.concat_ws(":", *[F.lower(F.regexp_replace(F.substring(hexed, 4 * i + 1, 4), "^0{1,3}", "")) for i in range(8)])


def _shortened(text: Column) -> Column:
    """The canonical text of an address: the longest run of zero groups as ``::``. ``text`` should be a column, as it is used often."""
    runs = [f"^((?:[0-9a-f]+:)*?)0(?::0){{{n - 1}}}(?::|$)" for n in range(8, 1, -1)]
    short = F.coalesce(*[F.when(text.rlike(p), F.regexp_replace(text, p, "$1:")) for p in runs], text)
    return F.regexp_replace(short, "^:", "::")


def decode_packets(df: DataFrame, data: str = "data") -> DataFrame:
    """Add src, dst, proto, sport, dport, tcp_flags and payload to Ethernet frames.

    IP addresses where there are any, else MAC addresses; ports for TCP and UDP only, in the first fragment. One VLAN tag and some extension headers of IPv6 are stepped over.
    """
    hexed = F.col("__hex")
    tagged = _number(hexed, 12, 2) == TYPE_VLAN
    step = df.withColumn("__hex", F.hex(F.substring(data, 1, 400))).select(
        "*", F.when(tagged, 18).otherwise(14).alias("__base"), F.when(tagged, _number(hexed, 16, 2)).otherwise(_number(hexed, 12, 2)).alias("__kind"))
    base, kind = F.col("__base"), F.col("__kind")
    step = step.select(
        "*", ((kind == TYPE_IPV4) & (F.length(data) >= base + 20)).alias("__ip"), ((kind == TYPE_IPV6) & (F.length(data) >= base + 40)).alias("__ip6"))
    ip, ip6, held = F.col("__ip"), F.col("__ip6"), step.columns
    at = F.when(ip, base + _byte(hexed, base).bitwiseAND(15) * 4).when(ip6, base + 40)
    step = step.select(*held, F.when(ip, _byte(hexed, base + 9)).when(ip6, _byte(hexed, base + 6)).alias("proto"), at.alias("__l4"), F.lit(False).alias("__later"))
    proto, l4, later = F.col("proto"), F.col("__l4"), F.col("__later")

    def stepped(at: Column, _: Column) -> Column:
        number, place, beyond = at["proto"], at["l4"], at["later"]
        more = number.isin(*EXTENSIONS, FRAGMENT) & (F.length(data) >= place + 8) & ~beyond
        size = F.when(number == FRAGMENT, 8).otherwise((_byte(hexed, place + 1) + 1) * 8)
        rest = (number == FRAGMENT) & (F.shiftright(_number(hexed, place + 2, 2).cast("int"), 3) > 0)
        return F.when(more, F.struct(_byte(hexed, place).alias("proto"), (place + size).alias("l4"), rest.alias("later"))).otherwise(at)

    # Only packets with extension headers are looked at again.
    start = F.struct("proto", F.col("__l4").alias("l4"), F.col("__later").alias("later"))
    extended = F.aggregate(F.array(*[F.lit(i) for i in range(EXTENSION_DEPTH)]), start, stepped)
    step = step.select("*", F.when(ip6 & proto.isin(*EXTENSIONS, FRAGMENT), extended).alias("__ext"))
    known = F.col("__ext").isNotNull()
    six = lambda at: F.when(ip6, _groups(F.substring(hexed, at * 2 + 1, F.lit(32))))
    step = step.select(
        *held, F.when(known, F.col("__ext.proto")).otherwise(proto).alias("proto"), F.when(known, F.col("__ext.l4")).otherwise(l4).alias("__l4"),
        F.when(known, F.col("__ext.later")).otherwise(later).alias("__later"), six(base + 8).alias("__from6"), six(base + 24).alias("__to6"))
    dotted = lambda at: F.concat_ws(".", *[_byte(hexed, at + i).cast("string") for i in range(4)])
    mac = lambda at: F.lower(F.concat_ws(":", *[F.substring(hexed, 2 * (at + i) + 1, 2) for i in range(6)]))
    ported = proto.isin(PROTO_TCP, PROTO_UDP) & (F.length(data) >= l4 + 4) & ~later
    tcp = (proto == PROTO_TCP) & (F.length(data) >= l4 + 14) & ~later
    start = F.when(tcp, l4 + F.shiftright(_byte(hexed, l4 + 12), 4) * 4).when(ported, l4 + 8)
    return step.select(
        *df.columns,
        F.when(ip, dotted(base + 12)).when(ip6, _shortened(F.col("__from6"))).otherwise(mac(6)).alias("src"),
        F.when(ip, dotted(base + 16)).when(ip6, _shortened(F.col("__to6"))).otherwise(mac(0)).alias("dst"),
        "proto", F.when(ported, _number(hexed, l4, 2)).cast("int").alias("sport"), F.when(ported, _number(hexed, l4 + 2, 2)).cast("int").alias("dport"),
        F.when(tcp, _byte(hexed, l4 + 13)).alias("tcp_flags"),
        F.when(start.isNotNull(), F.substring(F.col(data), start + 1, F.length(data))).alias("payload"),
    )
