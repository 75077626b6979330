"""Forms of a graph: both directions, degrees, layers, adjacency lists, attribute selections, label maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, self-loops once."""
    back = edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("src", "dst", "w").unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, a): row sums of the adjacency."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("a"))


def volume(edges: DataFrame) -> DataFrame:
    """One row m: the sum of all degrees, twice the total weight."""
    return edges.agg(F.sum(F.col("w") * F.when(F.col("src") == F.col("dst"), 1.0).otherwise(2.0)).alias("m"))


def unweighted(edges: DataFrame) -> DataFrame:
    """0/1 adjacency: duplicates and directions collapse."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("w", F.lit(1.0))


def upper_triangle(cells: DataFrame) -> DataFrame:
    """Cells above the diagonal."""
    return cells.filter("src < dst")


def unit_diagonal(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """The mean of every cell and its mirror image (an absent one is 0), both ways round, and 1 on the diagonal of every node."""
    back = cells.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    mean = cells.select("src", "dst", "w").unionByName(back).filter("src <> dst").groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))
    return mean.unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w")))


def undirected(edges: DataFrame) -> DataFrame:
    """Without self-loops; of parallel edges the heaviest."""
    ends = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    return ends.groupBy("src", "dst").agg(F.max("w").alias("w"))


def signed_layers(edges: DataFrame) -> DataFrame:
    """Positive weights in layer 0, negated negative ones in layer 1; zeros are no edges."""
    return edges.filter("w <> 0").select(F.when(F.col("w") > 0, 0).otherwise(1).alias("layer"), "src", "dst", F.abs("w").alias("w"))


def symmetrize(arcs: DataFrame) -> DataFrame:
    """Half the sum of an arc list and its reverse."""
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return arcs.select("src", "dst", "w").unionByName(back).groupBy("src", "dst").agg((F.sum("w") * 0.5).alias("w"))


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """(node, neighbours): sorted (dst, w) structs of each node, loops left out."""
    return both_ways(edges.filter("src <> dst")).groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("dst", "w"))).alias("neighbours"))


def by_attribute(rows: DataFrame, attribute: str, value=None) -> DataFrame:
    """Rows whose attribute equals the value, or without one is truthy: not null, false, zero or empty."""
    c = F.col(attribute)
    if value is not None:
        return rows.filter(c == F.lit(value))
    return rows.filter(c.isNotNull() & ~c.cast("string").isin("", "0", "0.0", "false"))


def unknown_labels(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Labels in pairs (u, v) that no node has; none may be left before pairs are mapped."""
    used = pairs.select(F.col("u").alias("label")).unionByName(pairs.select(F.col("v").alias("label"))).distinct()
    return used.join(nodes.select("label"), "label", "left_anti")


def map_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Label pairs (u, v) as distinct ordered node pairs; loops go. An unknown label raises."""
    if not unknown_labels(pairs, nodes).isEmpty():
        raise ValueError("pairs name labels that no node has")
    a = nodes.select(F.col("label").alias("u"), F.col("node").alias("a"))
    b = nodes.select(F.col("label").alias("v"), F.col("node").alias("b"))
    return pairs.join(a, "u").join(b, "v").filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def incidence_graph(incidence: DataFrame) -> DataFrame:
    """Constraints that share variables: (src, dst, weight, variables, var_types, var_type); integer only if all shared ones are.
    Rows that were exploded look smaller to Spark than they are, so neither side is broadcast."""
    a, b = incidence.alias("a"), incidence.hint("merge").alias("b")
    met = a.join(b, F.col("a.variable") == F.col("b.variable")).filter(F.col("a.constraint") < F.col("b.constraint"))
    return met.groupBy(F.col("a.constraint").alias("src"), F.col("b.constraint").alias("dst")).agg(
        F.count(F.lit(1)).alias("weight"), F.sort_array(F.collect_list("a.variable")).alias("variables"), F.sort_array(F.collect_set("a.kind")).alias("var_types"),
        F.when(F.min((F.col("a.kind") == "integer").cast("int")) == 1, "integer").otherwise("continuous").alias("var_type"),
    )


def two_hop(edges: DataFrame) -> DataFrame:
    """Pairs at distance two: a common neighbour and no edge."""
    s = both_ways(edges.filter("src <> dst")).select("src", "dst")
    a, b = s.alias("a"), s.alias("b")
    two = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("u"), F.col("b.dst").alias("v")).filter("u < v").distinct()
    return two.join(s.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_anti")


def matrix_cells(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Cells of an adjacency plot, nodes ordered by community: (i, j, w, same)."""
    place = membership.select("node", "community", (F.row_number().over(Window.orderBy("community", "node")) - 1).alias("place"))
    a, b = place.select(F.col("node").alias("src"), F.col("place").alias("i"), F.col("community").alias("ci")), place.select(F.col("node").alias("dst"), F.col("place").alias("j"), F.col("community").alias("cj"))
    return both_ways(edges).join(a, "src").join(b, "dst").select("i", "j", "w", (F.col("ci") == F.col("cj")).alias("same"))
