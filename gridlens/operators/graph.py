"""Communication graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.hashing import hash31
from gridlens.functions.scalar import ratio
from gridlens.session import cut_lineage


def undirected_edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Simple undirected edges (a <= b); repeated pairs collapse before the shuffle."""
    known = df.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    return known.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Degree per node; a self-loop counts twice."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def graph_metrics(edges: DataFrame) -> DataFrame:
    """Nodes, edges, average degree and density."""
    # Half the degree sum is the edge count, so one aggregate over degrees gives all four.
    row = degrees(edges).agg(F.count(F.lit(1)).alias("n_nodes"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("bigint").alias("n_edges"))
    n, e = F.col("n_nodes"), F.col("n_edges")
    return row.select(
        "n_nodes", "n_edges", ratio(2 * e, n).alias("avg_degree"), ratio(2 * e, n * (n - 1)).alias("density")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node id that can be reached.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in
    MapReduce and Beyond" (2014): each links neighbours to the smallest node around, which takes
    a logarithmic number of rounds where plain label passing takes as many as the graph is wide.
    The minimum per node is combined map-side, so a hub costs no single task its edges. Each round is
    checkpointed; the loop ends when a round changes no edge.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = cut_lineage(edges.where("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v")).distinct())
    signature = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        smallest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(smallest, "u")
        links = cut_lineage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u > v").distinct()
        )
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == signature:
            break
        signature = state
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


def node_sample(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Edges among n nodes drawn by hash order."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = cut_lineage(nodes.orderBy(hash31("node", seed), "node").limit(n))
    return edges.join(chosen.select(F.col("node").alias("a")), "a", "left_semi").join(
        chosen.select(F.col("node").alias("b")), "b", "left_semi"
    ).select("a", "b")
