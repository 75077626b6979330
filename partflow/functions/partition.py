"""Partitions as (node, community) tables, and what labels of their nodes can be turned into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partflow.sources.graphs import both_ways


def coassociation(membership: DataFrame) -> DataFrame:
    """Pairs (i < j) of nodes in one community."""
    a, b = membership.alias("a"), membership.alias("b")
    return a.join(b, F.col("a.community") == F.col("b.community")).filter("a.node < b.node").select(F.col("a.node").alias("i"), F.col("b.node").alias("j"))


def relabel_first(membership: DataFrame, base: int = 0) -> DataFrame:
    """Labels in the order in which communities first appear among ascending nodes."""
    firsts = membership.groupBy("community").agg(F.min("node").alias("first"))
    number = firsts.select("community", (F.dense_rank().over(Window.orderBy("first")) - 1 + base).alias("label"))
    return membership.join(number, "community").select("node", F.col("label").alias("community"))


def relabel_sorted(membership: DataFrame) -> DataFrame:
    """Labels 0.. in the order of the old ones."""
    number = membership.select("community").distinct().select("community", (F.dense_rank().over(Window.orderBy("community")) - 1).alias("label"))
    return membership.join(number, "community").select("node", F.col("label").alias("community"))


def communities(membership: DataFrame) -> DataFrame:
    """(community, nodes): labels from 1 by first appearance, sorted members."""
    return relabel_first(membership, 1).groupBy("community").agg(F.sort_array(F.collect_list("node")).alias("nodes"))


def threshold_partition(shares: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(node, r) -> 1 above the threshold, 0 at or below."""
    return shares.select("node", F.when(F.col("r") > threshold, 1).otherwise(0).alias("community"))


def sign_split(values: DataFrame) -> DataFrame:
    """(node, x) -> side +1 where x > 0, else -1, with the side's size."""
    side = values.select("node", F.when(F.col("x") > 0, 1).otherwise(-1).alias("side"))
    return side.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("side")))


def soft_membership(edges: DataFrame, membership: DataFrame, p: int = 1) -> DataFrame:
    """(node, community, share): each node's edge weight into each community, normalised in L1 or L2."""
    m = membership.select(F.col("node").alias("dst"), "community")
    mass = both_ways(edges).join(m, "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("x"))
    norm = F.sum("x") if p == 1 else F.sqrt(F.sum(F.col("x") * F.col("x")))
    total = mass.groupBy("node").agg(norm.alias("t"))
    return mass.join(total, "node").select("node", "community", F.when(F.col("t") > 0, F.col("x") / F.col("t")).otherwise(F.lit(0.0)).alias("share"))


def label_by_threshold(shares: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(node, label): the community of the largest share, the smallest of ties; -1 where that share is under the threshold."""
    best = shares.groupBy("node").agg(F.max(F.struct("share", -F.col("community"))).alias("b"))
    return best.select("node", F.when(F.col("b.share") < threshold, F.lit(-1)).otherwise(-F.col("b")["col2"]).cast("long").alias("label"))


def simple_partition(nodes: DataFrame, cannot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes in one community, and the pairs that the column nevertheless keeps apart."""
    return nodes.select("node", F.lit(0).alias("community")), cannot.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()


def round_robin(nodes: DataFrame, k: int) -> DataFrame:
    return nodes.select("node", F.pmod(F.row_number().over(Window.orderBy("node")) - 1, F.lit(k)).alias("community"))


def block_repair(values: DataFrame, blocks: DataFrame, binary: bool = False) -> DataFrame:
    """(node, x): the mean over each block, rounded half to even for binary values."""
    mean: Column = F.avg("x").over(Window.partitionBy("block"))
    return values.join(blocks, "node").select("node", (F.rint(mean) if binary else mean).alias("x"))


def refine_with_core(membership: DataFrame, core: DataFrame) -> DataFrame:
    """Core nodes in one community -1, the others keep theirs."""
    return membership.join(core.select("node", F.lit(True).alias("_core")), "node", "left").select("node", F.when(F.col("_core"), F.lit(-1)).otherwise(F.col("community")).cast("long").alias("community"))
