"""Must-link components, graph contraction and expansion, periphery components, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partflow.functions.partition import relabel_first
from partflow.operators.components import connected_components
from partflow.sources.graphs import both_ways


def link_components(nodes: DataFrame, must: DataFrame) -> DataFrame:
    """(node, comp): components of the must-links, numbered from 0 by their smallest node; every node has one."""
    found = connected_components(must)
    all_ = nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("community"))
    return relabel_first(all_).withColumnRenamed("community", "comp")


def component_conflicts(comp: DataFrame, cannot: DataFrame) -> DataFrame:
    """(a, b): pairs of components that a cannot-link keeps apart; a = b is a contradiction."""
    x, y = comp.select(F.col("node").alias("u"), F.col("comp").alias("cu")), comp.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
    return cannot.join(x, "u").join(y, "v").select(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).distinct()


def links_feasible(comp: DataFrame, cannot: DataFrame) -> DataFrame:
    return component_conflicts(comp, cannot).agg(F.count(F.when(F.col("a") == F.col("b"), 1)).alias("contradictions")).select("contradictions", (F.col("contradictions") == 0).alias("feasible"))


def contract_graph(edges: DataFrame, comp: DataFrame, keep_loops: bool = True, preserve_degrees: bool = True) -> DataFrame:
    """Edges between components, weights summed. A component's own weight is a loop, counted twice to keep its degree (a loop that was
    there before counts once)."""
    x, y = comp.select(F.col("node").alias("src"), F.col("comp").alias("a")), comp.select(F.col("node").alias("dst"), F.col("comp").alias("b"))
    w = F.when((F.col("a") == F.col("b")) & (F.col("src") != F.col("dst")), F.col("w") * (2.0 if preserve_degrees else 1.0)).otherwise(F.col("w"))
    out = edges.join(x, "src").join(y, "dst").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), w.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return out if keep_loops else out.filter("src <> dst")


def unworthy_edges(edges: DataFrame, worthy: DataFrame) -> DataFrame:
    """Edges that no worthy pair names."""
    w = worthy.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"))
    return edges.filter("w > 0").join(w, ["src", "dst"], "left_anti")


def contract_pairs(pairs: DataFrame, comp: DataFrame, reject_internal: bool = False) -> DataFrame:
    """Node pairs as distinct ordered component pairs; internal ones go, or raise."""
    both = component_conflicts(comp, pairs)
    if reject_internal and not both.filter("a = b").isEmpty():
        raise ValueError("a pair lies inside a contracted component")
    return both.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))


def contract_partition(membership: DataFrame, comp: DataFrame) -> DataFrame:
    """The partition of components; it must be constant on each."""
    per = membership.join(comp, "node").groupBy("comp").agg(F.min("community").alias("community"), F.max("community").alias("_top"))
    if not per.filter("community <> _top").isEmpty():
        raise ValueError("the partition is not constant on a component")
    return per.select(F.col("comp").alias("node"), "community")


def expand_partition(membership: DataFrame, comp: DataFrame) -> DataFrame:
    """The partition of nodes that a partition of their components makes."""
    return comp.join(membership.select(F.col("node").alias("comp"), "community"), "comp").select("node", "community")


def aggregate_graph(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Communities as nodes: M'AM as an edge list, inside weight counted both ways on the loop."""
    return contract_graph(edges, membership.select("node", F.col("community").alias("comp")))


def periphery_components(edges: DataFrame, core: DataFrame, nodes: DataFrame, must: DataFrame | None = None) -> DataFrame:
    """Core nodes 0; connected pieces of the rest, must-links joining pieces, 1.. by smallest node. A must-link across the border raises."""
    rest = nodes.select("node").join(core.select("node"), "node", "left_anti")
    ends = edges.filter("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if must is not None:
        mixed = must.join(core.select(F.col("node").alias("u"), F.lit(1).alias("cu")), "u", "left").join(core.select(F.col("node").alias("v"), F.lit(1).alias("cv")), "v", "left")
        if not mixed.filter("coalesce(cu, 0) <> coalesce(cv, 0)").isEmpty():
            raise ValueError("a must-link crosses the core's border")
        ends = ends.unionByName(must.select("u", "v"))
    inner = ends.join(rest.select(F.col("node").alias("u")), "u", "left_semi").join(rest.select(F.col("node").alias("v")), "v", "left_semi")
    comp = link_components(rest, inner).select("node", (F.col("comp") + 1).alias("community"))
    return comp.unionByName(core.select("node", F.lit(0).cast("long").alias("community")))


def fingerprint_blocks(pool: DataFrame) -> DataFrame:
    """(node, block): nodes that every partition of a pool (part_id, node, community) puts together, 0.. by smallest node."""
    print_ = pool.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("part_id", "community"))).cast("string").alias("community"))
    return relabel_first(print_).withColumnRenamed("community", "block")


def coassociation_share(pool: DataFrame) -> DataFrame:
    """(i, j, share): of a pool's partitions those that put i < j together."""
    a, b = pool.alias("a"), pool.alias("b")
    runs = pool.select("part_id").distinct().agg(F.count(F.lit(1)).alias("runs"))
    both = a.join(b, (F.col("a.part_id") == F.col("b.part_id")) & (F.col("a.community") == F.col("b.community"))).filter("a.node < b.node")
    return both.groupBy(F.col("a.node").alias("i"), F.col("b.node").alias("j")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(runs)).select("i", "j", (F.col("n") / F.col("runs")).alias("share"))


def color_refinement(edges: DataFrame, nodes: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, color) after rounds of 1-dimensional refinement: a coarsening of the automorphism orbits. Colors are dense ranks of
    (color, sorted (weight, color) of the neighbours)."""
    s = both_ways(edges)
    color = nodes.select("node", F.lit(0).cast("long").alias("color"))
    for _ in range(rounds):
        near = s.join(color.select(F.col("node").alias("dst"), F.col("color").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("w", "c"))), lambda x: F.concat_ws(":", x["w"].cast("long").cast("string"), x["c"].cast("string"))), ",").alias("near"))
        keyed = color.join(near, "node", "left").select("node", "color", F.coalesce("near", F.lit("")).alias("near"))
        color = keyed.select("node", (F.dense_rank().over(Window.orderBy("color", "near")) - 1).cast("long").alias("color"))
    return color


def component_order(order: DataFrame, comp: DataFrame) -> DataFrame:
    """(comp, position): components in the order in which a node order (node, pos) first meets them, the others behind by number."""
    met = comp.join(order, "node", "left").groupBy("comp").agg(F.min("pos").alias("pos"))
    return met.select("comp", (F.row_number().over(Window.orderBy(F.col("pos").asc_nulls_last(), "comp")) - 1).alias("position"))
