"""Density clusters of sparse vectors by a grid join, and labels from them.

Points that are equal become one point that counts as often as they occur. Points within eps of each other differ by eps at most in every
dimension, so they lie in the same or touching cells of a grid of width eps over the two dimensions that spread most; only such points are
compared, by their whole vectors. No table of all pairs is formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partflow.functions.partition import label_by_threshold
from partflow.functions.storage import cut
from partflow.operators.components import connected_components

#: Values whose distinct maxima spread less than this are scaled first.
NARROW = 0.25


def scaled(shares: DataFrame) -> DataFrame:
    """Shares scaled by the smallest and largest of the nodes' largest shares, not below 0, if the distinct ones among these have a standard
    deviation under NARROW; else as they are."""
    top = shares.groupBy("node").agg(F.max("share").alias("p"))
    spread = top.agg(F.min("p").alias("low"), F.max("p").alias("high")).crossJoin(top.select("p").distinct().agg(F.coalesce(F.stddev_pop("p"), F.lit(0.0)).alias("sd")))
    rows = shares.crossJoin(F.broadcast(spread))
    fit = F.greatest((F.col("share") - F.col("low")) / (F.col("high") - F.col("low") + 1e-12), F.lit(0.0))
    return rows.select("node", "community", F.when(F.col("sd") < NARROW, fit).otherwise(F.col("share")).alias("share"))


def points(shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct points: node, times, v, q; which point each node is). A point is named by its smallest node; v maps dimensions to values other
    than 0, q is the squared length. A null share counts as 0."""
    v = F.sort_array(F.collect_list(F.when(F.col("share") != 0, F.struct("community", "share"))))
    rows = cut(shares.groupBy("node").agg(v.alias("key")).withColumn("name", F.xxhash64("key")), "vectors")
    same = rows.groupBy("name", "key").agg(F.min("node").alias("point"), F.count(F.lit(1)).alias("times"))
    of = cut(rows.join(same, ["name", "key"]).select("node", "point"), "points")
    q = F.aggregate("key", F.lit(0.0), lambda t, x: t + x["share"] * x["share"])
    return cut(same.select(F.col("point").alias("node"), "times", F.map_from_entries("key").alias("v"), q.alias("q")), "distinct"), of


def near_pairs(at: DataFrame, eps: float) -> DataFrame:
    """(u, v), both ways and each with itself, of points (node, v, q) within eps."""
    n = at.count()
    if not n:
        return at.select(F.col("node").alias("u"), F.col("node").alias("v"))
    x = at.select(F.explode("v").alias("dim", "x")).groupBy("dim").agg((F.sum(F.col("x") * F.col("x")) / n - (F.sum("x") / n) ** 2).alias("spread"))
    dims = [r["dim"] for r in x.orderBy(F.desc("spread"), "dim").limit(2).collect()]
    cells = [F.floor(F.coalesce(F.element_at("v", F.lit(d)), F.lit(0.0)) / eps) for d in dims] + [F.lit(0).cast("long")] * (2 - len(dims))
    rows = cut(at.select("node", "v", "q", cells[0].alias("i"), cells[1].alias("j")), "cells")
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    left = rows.select(F.col("node").alias("u"), F.col("v").alias("a"), F.col("q").alias("qa"), "i", "j").withColumn("di", F.explode(step)).withColumn("dj", F.explode(step))
    left = left.select("u", "a", "qa", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
    both = left.join(rows.select("node", F.col("v").alias("b"), F.col("q").alias("qb"), "i", "j"), ["i", "j"]).filter("u < node")
    dot = F.aggregate(F.map_entries("a"), F.lit(0.0), lambda t, e: t + e["value"] * F.coalesce(F.element_at("b", e["key"]), F.lit(0.0)))
    found = cut(both.filter(F.col("qa") + F.col("qb") - 2 * dot <= eps * eps + 1e-12).select("u", F.col("node").alias("v")), "near")
    return found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(at.select(F.col("node").alias("u"), F.col("node").alias("v")))


def clusters(shares: DataFrame, eps: float, least: int) -> DataFrame:
    """(node, c): the smallest core node of a node's cluster, -1 for noise. A node is core with `least` nodes within eps, itself included;
    a node between clusters goes to the one of the smallest name."""
    at, of = points(shares)
    near = cut(near_pairs(at, eps), "near")
    count = near.join(at.select(F.col("node").alias("v"), "times"), "v").groupBy("u").agg(F.sum("times").alias("k"))
    core = cut(count.filter(F.col("k") >= least).select(F.col("u").alias("core")), "core")
    inner = near.join(core.withColumnRenamed("core", "u"), "u").join(core.withColumnRenamed("core", "v"), "v").select("u", "v")
    comp = connected_components(inner)
    found = near.join(comp.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("point")).agg(F.min("component").alias("c"))
    return of.join(found, "point", "left").select("node", F.coalesce("c", F.lit(-1)).alias("c"))


def _but_rarest(found: DataFrame) -> DataFrame:
    """(node, c, rare): whether a node's label is the one that fewest have, the smallest of ties."""
    rarest = found.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "c").limit(1).select(F.col("c").alias("r"))
    return found.crossJoin(F.broadcast(rarest)).select("node", "c", (F.col("c") == F.col("r")).alias("rare"))


def label_by_cluster(shares: DataFrame, eps: float = 0.5, least: int = 5) -> DataFrame:
    """(node, label): the cluster's smallest core node; -1 for noise and for the rarest label."""
    return _but_rarest(clusters(shares, eps, least)).select("node", F.when(F.col("rare") | (F.col("c") < 0), F.lit(-1)).otherwise(F.col("c")).cast("long").alias("label"))


def label_by_density(shares: DataFrame, eps: float = 0.5, least: int = 5) -> DataFrame:
    """(node, label): shares are scaled if they are narrow; nodes of the rarest cluster label (noise is one) get -1, all others the community of
    their largest share."""
    flags = _but_rarest(clusters(scaled(shares), eps, least))
    return label_by_threshold(shares, 0.0).join(flags, "node").select("node", F.when(F.col("rare"), F.lit(-1)).otherwise(F.col("label")).cast("long").alias("label"))
