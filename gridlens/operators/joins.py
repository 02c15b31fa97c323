"""Packet and flow joins that stay linear in their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators import ordered


def enrich(packets: DataFrame, flows: DataFrame, on: list[str]) -> DataFrame:
    """Left equi-join on the endpoint key; broadcast, sort-merge and skew splits are the optimizer's choice."""
    return packets.join(flows, on, "left")


def align_predictions(truth: DataFrame, predicted: DataFrame, row_id: str) -> DataFrame:
    return truth.join(predicted, row_id, "inner")


def flow_of_packet(packets: DataFrame, flows: DataFrame, key: list[str], ts: str, packet_id: str,
                   start: str, end: str, flow_id: str) -> DataFrame:
    """Attach to each packet the flow of its key that contains its time (null if none does).

    The latest flow that started at or before the packet is carried forward over one sorted
    sequence and checked against its end. That is the containing flow, because a meter opens the
    next flow of a key only after the last one has ended. One row per packet; no pairs.
    """
    left = packets.select(
        *key, F.col(ts).alias("__t"), F.lit(1).alias("__kind"), F.col(packet_id).alias("__id"),
        F.lit(None).cast(flows.schema[flow_id].dataType).alias("__flow"),
        F.lit(None).cast(flows.schema[end].dataType).alias("__end"),
    )
    right = flows.select(
        *key, F.col(start).alias("__t"), F.lit(0).alias("__kind"), F.col(flow_id).cast(packets.schema[packet_id].dataType).alias("__id"),
        F.col(flow_id).alias("__flow"), F.col(end).alias("__end"),
    )
    opened = F.when(F.col("__kind") == 0, F.struct("__flow", "__end"))
    carried = ordered.scan(
        left.unionByName(right), key, ["__t", "__kind", "__id"], [ordered.running("__open", "last", opened)]
    ).where("__kind = 1")
    inside = F.col("__t") <= F.col("__open.__end")
    return carried.select(
        *key, F.col("__id").alias(packet_id), F.col("__t").alias(ts), F.when(inside, F.col("__open.__flow")).alias(flow_id)
    )


def packets_in_lifetime(packets: DataFrame, flows: DataFrame, key: list[str], ts: str, value: str,
                        start: str, end: str, flow_id: str) -> DataFrame:
    """Packet count and value sum inside [start, end] of each flow; lifetimes may overlap freely.

    Both are differences of running totals at the two ends, so the work is one sort of
    packets plus two markers per flow, however many packets each flow covers. Values are summed
    as decimals of six places: differences of long double totals would lose digits.
    """
    nothing = F.lit(None).cast(flows.schema[flow_id].dataType)
    moves = packets.select(
        *key, F.col(ts).alias("__t"), F.lit(1).alias("__kind"), nothing.alias(flow_id),
        F.lit(1).alias("__one"), F.col(value).cast("decimal(28,6)").alias("__v"),
    )
    marks = [
        flows.select(*key, F.col(c).alias("__t"), F.lit(k).alias("__kind"), F.col(flow_id), F.lit(0).alias("__one"), F.lit(0).cast("decimal(28,6)").alias("__v"))
        for c, k in ((start, 0), (end, 2))
    ]
    # Ties inside one kind may stand in any order: only totals between kinds are read.
    totals = ordered.scan(
        moves.unionByName(marks[0]).unionByName(marks[1]), key, ["__t", "__kind", flow_id],
        [ordered.running("__n", "sum", "__one"), ordered.running("__s", "sum", "__v")],
    ).where("__kind <> 1")
    at = lambda kind, c: F.max(F.when(F.col("__kind") == kind, F.col(c)))
    return totals.groupBy(*key, flow_id).agg(
        (at(2, "__n") - at(0, "__n")).alias("n_packets"), (at(2, "__s") - at(0, "__s")).cast("double").alias("value_sum")
    )


def syn_ack_pairs(packets: DataFrame, flow: list[str], order: list[str], ts_us: str, flags: str) -> DataFrame:
    """Round trips: a SYN and the next pure ACK of the same directed flow.

    A SYN (also with ACK set) becomes the pending one, an ACK uses it up even if its delay lies outside
    0 to 1000 ms. Among SYN and ACK rows only, an ACK therefore pairs exactly if the row before it
    is a SYN.
    """
    syn = F.col(flags).bitwiseAND(2) != 0
    ack = F.col(flags).bitwiseAND(16) != 0
    kept = packets.where(syn | ack).withColumn("__syn", syn)
    lagged = ordered.scan(
        kept, flow, order, [ordered.lag("__was_syn", "__syn"), ordered.lag("__then", ts_us)]
    )
    rtt = (F.col(ts_us) - F.col("__then")) / 1000.0
    pairs = lagged.where(~F.col("__syn") & F.col("__was_syn")).withColumn("rtt_ms", rtt)
    return pairs.where((F.col("rtt_ms") > 0) & (F.col("rtt_ms") < 1000)).drop("__syn", "__was_syn", "__then")
