"""Labels, lists and firewall rules as predicates and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.scalar import col, ipv4_to_long
from gridlens.session import LOOKUP_ROWS, cut_lineage, lookup

# Words that mark attack and benign text, and names of normal traffic.
ATTACK_WORDS = ("attack", "malicious", "threat", "dos", "mitm", "breach", "intrusion", "exploit")
NORMAL_WORDS = ("normal", "benign", "legitimate")
NORMAL_NAMES = ("normal", "benign", "legitimate", "none", "clean", "safe")
# Command type ids and unknown causes of transmission of the telecontrol protocol.
COMMAND_TYPES = (45, 46, 47)
UNKNOWN_CAUSES = (41, 42, 43, 44)
MAX_APDU_LENGTH = 253
CONTROL_VALUES = (0, 1, 3)


def keyword_label(text: Column | str, attack=ATTACK_WORDS, normal=NORMAL_WORDS) -> Column:
    """1 where an attack word occurs, else 0 where a normal word occurs, else 1."""
    lowered = F.lower(col(text))
    return F.when(lowered.rlike("|".join(attack)), 1).when(lowered.rlike("|".join(normal)), 0).otherwise(1)


def binary_label(label: Column | str, normal: str = "NORMAL") -> Column:
    """0 for the normal class (case-blind), 1 for every other non-null label."""
    return F.when(col(label).isNotNull(), (F.upper(F.trim(col(label))) != normal.upper()).cast("int"))


def blocked_flag(attack_type: Column | str, names=NORMAL_NAMES) -> Column:
    """True where the trimmed lower-case type is no name of normal traffic."""
    return ~F.lower(F.trim(col(attack_type))).isin(*names)


def offending_sources(df: DataFrame, source: str, label: str, normal: str = "normal") -> DataFrame:
    """Distinct sources with any label other than normal."""
    return df.where(F.lower(F.trim(F.col(label))) != normal).select(source).distinct()


def exclude(df: DataFrame, block_list: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not listed. The list's measured size decides between broadcast and shuffle."""
    return df.join(lookup(block_list.select(*on).distinct()), on, "left_anti")


def include(df: DataFrame, allow_list: DataFrame, on: list[str]) -> DataFrame:
    return df.join(lookup(allow_list.select(*on).distinct()), on, "left_semi")


def firewall_check(df: DataFrame, source: str, port: str, black: DataFrame, ports: DataFrame) -> DataFrame:
    """``allowed`` = source not listed in ``black(ip)`` and port listed in ``ports(port)``."""
    blacklist = lookup(black.select(F.col("ip").alias(source)).distinct().withColumn("__listed", F.lit(True)))
    allowed = lookup(ports.select(F.col("port").alias(port)).distinct().withColumn("__open", F.lit(True)))
    marked = df.join(blacklist, source, "left").join(allowed, port, "left")
    return marked.select(*df.columns, (F.col("__listed").isNull() & F.col("__open").isNotNull()).alias("allowed"))


def cidr_action(df: DataFrame, ip: str, rules: DataFrame, default: str = "ALLOW") -> DataFrame:
    """Action and rule of the longest active prefix that contains the address (lowest rule_id on a tie).

    An address lies in a prefix of length n exactly if their first n bits are equal, so the
    range join becomes one equi-join per distinct prefix length (at most 33), most specific
    first. Joins keep one row per address; nothing is exploded or compared pairwise. A rule table of
    ordinary size is broadcast, and the rows are not moved at all.
    """
    active = cut_lineage(rules.where("active").select(
        "rule_id", "action",
        F.split("src_cidr", "/")[1].cast("int").alias("bits"),
        ipv4_to_long(F.split("src_cidr", "/")[0]).alias("net"),
    ))
    sizes = {r[0]: r[1] for r in active.groupBy("bits").agg(F.count(F.lit(1))).collect()}  # at most 33 rows
    lengths = sorted(sizes, reverse=True)
    out = df.withColumn("__ip", ipv4_to_long(ip))
    for n in lengths:
        best = (
            active.where(F.col("bits") == n)
            .groupBy(F.shiftright("net", 32 - n).alias(f"__net{n}"))
            .agg(F.min(F.struct("rule_id", "action")).alias(f"__hit{n}"))
        )
        best = F.broadcast(best) if sizes[n] <= LOOKUP_ROWS else best
        out = out.withColumn(f"__net{n}", F.shiftright("__ip", 32 - n)).join(best, f"__net{n}", "left")
    hit = F.coalesce(*[F.col(f"__hit{n}") for n in lengths]) if lengths else F.lit(None).cast("struct<rule_id:int,action:string>")
    return out.select(*df.columns, hit["rule_id"].alias("rule_id"), F.coalesce(hit["action"], F.lit(default)).alias("action"))


def frame_violations(length: Column | str, controls: list[Column | str]) -> Column:
    """Names of the broken range rules of a frame as an array (empty where it is valid)."""
    checks = [F.when(col(length) > MAX_APDU_LENGTH, F.lit("apdu_length"))]
    checks += [F.when(~col(c).isin(*CONTROL_VALUES), F.lit(f"control_{i}")) for i, c in enumerate(controls, 1)]
    return F.filter(F.array(*checks), lambda v: v.isNotNull())


def is_command(type_id: Column | str) -> Column:
    return col(type_id).isin(*COMMAND_TYPES)


def is_unknown_cause(cause: Column | str) -> Column:
    return col(cause).isin(*UNKNOWN_CAUSES)


def vector_error(features: Column | str, width: int | None = None, model: Column | str | None = None,
                 known_models: tuple[str, ...] = ()) -> Column:
    """Why a scoring request cannot be scored, or null."""
    x = col(features)
    reason = F.when(x.isNull() | (F.size(x) == 0), "empty")
    reason = reason.when(F.exists(x, lambda v: v.isNull() | F.isnan(v)), "not_numeric")
    if width is not None:
        reason = reason.when(F.size(x) != width, "width")
    if model is not None:
        reason = reason.when(~F.coalesce(col(model).isin(*known_models), F.lit(False)), "unknown_model")
    return reason


def auto_block(df: DataFrame, source: str, order: list[str], confidence: str, threshold: float = 0.9) -> DataFrame:
    """Rows up to and including the first one of each source above the threshold; later ones are skipped.

    The blocking point is a map-side minimum per source; no source's rows are gathered.
    """
    point = F.struct(*order)
    first = df.where(F.col(confidence) > threshold).groupBy(source).agg(F.min(point).alias("__blocked_at"))
    joined = df.join(lookup(first), source, "left").where(F.col("__blocked_at").isNull() | (point <= F.col("__blocked_at")))
    return joined.select(*df.columns, (point == F.col("__blocked_at")).alias("__b")).withColumn(
        "blocks", F.coalesce("__b", F.lit(False))
    ).drop("__b")
