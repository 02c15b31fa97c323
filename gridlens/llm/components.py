"""Connected components of links between ids, with hubs of any size.

Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014) until no link changes, which
takes a logarithmic number of rounds. The least neighbour of each node is combined map-side and written before it is joined, so both
sides of the join are plain scans and Spark can split the partition of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import stage


def _towards_least(links: DataFrame, name: str) -> DataFrame:
    """Join every (u, v) with the least of u and its neighbours."""
    least = stage(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    return links.join(least, "u")


def label(links: DataFrame) -> DataFrame:
    """(node, least): the smallest node that each node of the links (columns src, dst) reaches; nodes without links are absent."""
    pairs = links.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    pairs = stage(pairs.distinct(), "links")
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both, "least-large").filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        small = _towards_least(large, "least-small")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        pairs = stage(small.filter("u > v").distinct(), "small-star")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("least"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())
