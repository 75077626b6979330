"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partflow.functions.storage import cut, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest one: of every node its larger neighbours (large), or its smaller ones and itself (small)."""
    if large:
        pairs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return tuple(r)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge list (u, v); component is the smallest node. Self-loops make a node of their own."""
    edges = cut(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u is not null and v is not null"), "edges")
    alone = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    stars = edges.filter("u <> v").distinct()
    mark = None
    for _ in range(rounds):
        old, stars = stars, cut(_star(_star(stars, True), False), "stars")
        release(old)
        new = _mark(stars)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"no fixpoint after {rounds} rounds")
    return alone.join(stars.select(F.col("u").alias("node"), F.col("v").alias("_m")), "node", "left").select("node", F.coalesce("_m", "node").alias("component"))
