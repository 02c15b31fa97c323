"""Views of the given tables as telemetry, with the same views as SQL text for the reference queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.scalar import micros

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Round measures so that two engines' sums in different order compare equal."""
    return df.select(*[
        (F.round(F.col(c).cast("double"), digits) + 0.0).alias(c) if c in columns else F.col(c) for c in df.columns
    ])


def packets(events: DataFrame) -> DataFrame:
    """Events as packets: source address from the user, ports and TCP flags from the payload number."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("packet_id"), "ts", micros("ts").alias("ts_us"),
        source_ip("user_id").alias("src"), F.lit("10.9.9.9").alias("dst"),
        (F.lit(1024) + F.pmod("user_id", F.lit(50000))).cast("int").alias("sport"),
        F.when(k < 50, 2404).otherwise(80).cast("int").alias("dport"),
        F.element_at(F.array(F.lit(2), F.lit(16), F.lit(24), F.lit(18)), (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("flags"),
        (F.lit(54) + k).cast("int").alias("length"), "user_id", "event_type", "value", k.alias("k"),
    )


def source_ip(user):
    user = F.col(user)
    return F.concat(F.lit("10."), F.pmod(user, F.lit(4)), F.lit("."), F.pmod(user, F.lit(256)), F.lit(".7"))


SOURCE_IP_SQL = "('10.' || (user_id % 4) || '.' || (user_id % 256) || '.7')"

PACKETS_SQL = f"""
packets AS (
  SELECT event_id AS packet_id, ts, epoch_us(ts) AS ts_us, {SOURCE_IP_SQL} AS src, '10.9.9.9' AS dst,
         CAST(1024 + user_id % 50000 AS INTEGER) AS sport,
         CASE WHEN CAST(props->>'$.k' AS INTEGER) < 50 THEN 2404 ELSE 80 END AS dport,
         ([2, 16, 24, 18])[CAST(event_id % 4 AS INTEGER) + 1] AS flags,
         54 + CAST(props->>'$.k' AS INTEGER) AS length, user_id, event_type, value,
         CAST(props->>'$.k' AS INTEGER) AS k
  FROM events)
"""


def event_alerts(events: DataFrame) -> DataFrame:
    """Events as alerts: a confidence in [0, 1) from the payload number."""
    return events.withColumn("confidence", F.get_json_object("props", "$.k").cast("int") / 100.0)


ALERTS_SQL = "alerts AS (SELECT *, CAST(props->>'$.k' AS INTEGER) / 100.0::DOUBLE AS confidence FROM events)"


def vector_columns(embeddings: DataFrame, k: int) -> DataFrame:
    """The first k vector elements as double columns f0 … with the id and label."""
    return embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(k)])


def vector_columns_sql(k: int) -> str:
    return "vecs AS (SELECT vec_id, label, " + ", ".join(
        f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(k)
    ) + " FROM embeddings)"
