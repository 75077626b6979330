"""Community detection steps that are joins and aggregations, orders of nodes, and label rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partflow.functions.metrics import be_score, community_sums
from partflow.functions.partition import label_by_threshold
from partflow.functions.storage import cut
from partflow.sources.graphs import both_ways, degrees, volume


def degree_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, pos): most neighbours first, ties from the largest id down; weights don't count."""
    k = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    return nodes.select("node").join(k, "node", "left").select("node", (F.row_number().over(Window.orderBy(F.desc(F.coalesce("k", F.lit(0))), F.desc("node"))) - 1).cast("long").alias("pos"))


def bfs_levels(edges: DataFrame, start: int) -> DataFrame:
    """(node, level) of the nodes reached from a start; one join a level."""
    s = both_ways(edges).select("src", "dst")
    seen = edges.sparkSession.createDataFrame([(start, 0)], "node bigint, level int")
    front, level = seen, 0
    while True:
        level += 1
        new = s.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut(new.withColumn("level", F.lit(level)), "front")
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front), "seen")


def dfs_order(spark: SparkSession, graph) -> DataFrame:
    """(node, pos) depth first from the node of most neighbours, other pieces by the same rule."""
    k = (graph.a > 0).sum(1)
    left, out = set(range(len(k))), []
    while left:
        stack = [max(left, key=lambda i: (k[i], -i))]
        while stack:
            i = stack.pop()
            if i in left:
                left.discard(i)
                out.append(i)
                stack += [int(j) for j in np.flatnonzero(graph.a[i])[::-1] if j in left]
    return spark.createDataFrame([(int(graph.nodes[i]), p) for p, i in enumerate(out)], "node bigint, pos bigint")


def balanced_chunks(order: DataFrame, k: int) -> DataFrame:
    """(node, community): an order cut into k chunks of even size, the first ones larger by one."""
    n = order.agg(F.count(F.lit(1)).alias("n"))
    p = F.row_number().over(Window.orderBy("pos", "node")) - 1
    base, extra = F.floor(F.col("n") / k), F.pmod("n", F.lit(k))
    rows = order.crossJoin(F.broadcast(n)).withColumn("p", p)
    large = extra * (base + 1)
    return rows.select("node", F.when(F.col("p") < large, F.floor(F.col("p") / (base + 1))).otherwise(extra + F.floor((F.col("p") - large) / base)).cast("long").alias("community"))


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label) after synchronous rounds: the heaviest label among neighbours, the smallest of ties."""
    s = both_ways(edges.filter("src <> dst"))
    label = s.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        mass = s.join(label.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("w").alias("w"))
        label = cut(mass.groupBy("node").agg(F.max(F.struct("w", -F.col("label"))).alias("b")).select("node", (-F.col("b")["col2"]).alias("label")), "labels")
    return label


def best_merge(edges: DataFrame) -> DataFrame:
    """(a, b, gain): the two linked nodes whose merging raises modularity most, ties to the smallest."""
    a = degrees(edges)
    rows = edges.filter("src <> dst").join(a.select(F.col("node").alias("src"), F.col("a").alias("x")), "src").join(a.select(F.col("node").alias("dst"), F.col("a").alias("y")), "dst").crossJoin(F.broadcast(volume(edges)))
    gain = F.round(2 * (F.col("w") / F.col("m") - F.col("x") * F.col("y") / (F.col("m") * F.col("m"))), 12)
    return rows.select(F.col("src").alias("a"), F.col("dst").alias("b"), gain.alias("gain")).orderBy(F.desc("gain"), "a", "b").limit(1)


def random_walk(edges: DataFrame, steps: int) -> DataFrame:
    """(u, v, p): where a walk of `steps` steps from u ends."""
    step = both_ways(edges).join(degrees(edges).withColumnRenamed("node", "src"), "src").select("src", "dst", (F.col("w") / F.col("a")).alias("q"))
    walk = step.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("q").alias("p"))
    for _ in range(steps - 1):
        walk = walk.join(step, F.col("v") == F.col("src")).groupBy("u", "dst").agg(F.sum(F.col("p") * F.col("q")).alias("p")).select("u", F.col("dst").alias("v"), "p")
    return walk


def map_equation(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row `codelength`, in bits, of a random walk under a two-level code of the partition."""

    def term(x):
        return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))

    m = volume(edges)
    rows = community_sums(edges, membership).crossJoin(F.broadcast(m)).select((F.col("total") / F.col("m")).alias("p"), ((F.col("total") - F.col("inside")) / F.col("m")).alias("q"))
    top = rows.agg(F.sum("q").alias("exits"), F.sum(term(F.col("q"))).alias("q2"), F.sum(term(F.col("q") + F.col("p"))).alias("pq"))
    at = degrees(edges).crossJoin(F.broadcast(m)).agg(F.sum(term(F.col("a") / F.col("m"))).alias("nodes"))
    return top.crossJoin(at).select((term(F.col("exits")) - 2 * F.col("q2") - F.col("nodes") + F.col("pq")).alias("codelength"))


def cpm_quality(edges: DataFrame, membership: DataFrame, gamma: float) -> DataFrame:
    """One row `quality`: inside weight less gamma for each pair in a community."""
    inside = community_sums(edges.filter("src <> dst"), membership).agg((F.sum("inside") / 2).alias("w"))
    size = membership.groupBy("community").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    return inside.crossJoin(size).select((F.col("w") - gamma * F.col("pairs")).alias("quality"))


def surprise_quality(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row `quality`: edges times the divergence of the inside share from what pairs alone would give."""
    a, b = membership.select(F.col("node").alias("src"), F.col("community").alias("x")), membership.select(F.col("node").alias("dst"), F.col("community").alias("y"))
    share = edges.join(a, "src").join(b, "dst").agg(F.count(F.lit(1)).alias("m"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("q"))
    size = membership.groupBy("community").agg(F.count(F.lit(1)).alias("n")).agg((F.sum(F.col("n") * (F.col("n") - 1) / 2) / (F.sum("n") * (F.sum("n") - 1) / 2)).alias("e"))
    q, e = F.col("q"), F.col("e")
    return share.crossJoin(size).select((F.col("m") * (F.when(q > 0, q * F.log(q / e)).otherwise(0.0) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - e))).otherwise(0.0))).alias("quality"))


def heavy_edge_matching(edges: DataFrame) -> DataFrame:
    """(u, v): nodes that are each other's heaviest neighbour, ties to the smallest."""
    top = both_ways(edges.filter("src <> dst")).groupBy("src").agg(F.max(F.struct("w", -F.col("dst"))).alias("b")).select(F.col("src").alias("u"), (-F.col("b")["col2"]).alias("v"))
    return top.join(top.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"]).filter("u < v")


def quantize(edges: DataFrame, top: int) -> DataFrame:
    """Integer weights, the heaviest `top`, rounded half to even; negative or undefined weights raise, as does a graph that would lose all."""
    bad = edges.filter("w < 0 or isnan(w) or w is null").limit(1)
    if not bad.isEmpty():
        raise ValueError("weights must be finite and not negative")
    most = edges.agg(F.max("w").alias("most"))
    out = edges.crossJoin(F.broadcast(most)).select("src", "dst", F.rint(F.col("w") * top / F.col("most")).cast("long").alias("w"))
    if out.filter("w > 0").isEmpty():
        raise ValueError("no weight is left")
    return out


def integer_weights(edges: DataFrame, resolution: float = 1e-7, total: int = 1 << 50) -> tuple[DataFrame, float]:
    """(edges with integer weights, the scale they were multiplied by). Loops go, parallel edges and both directions are averaged as a
    symmetric matrix's cells are. Weights that are whole numbers stay as they are if twice their sum is at most `total`; others are scaled so
    that the heaviest keeps `resolution`, as far as `total` allows, and rounded half to even.

    Raises for negative or undefined weights, without an edge of positive weight, where the sum would be beyond `total`, and where rounding
    to 0 would lose more than the share `resolution` of the weight."""
    if resolution <= 0 or total <= 0:
        raise ValueError("resolution and total must be positive")
    if not edges.filter("w < 0 or isnan(w) or w is null or abs(w) = double('infinity')").limit(1).isEmpty():
        raise ValueError("weights must be finite and not negative")
    cells = cut(edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(F.col("w").cast("double")).alias("w")), "cells")
    cells = cells.filter("w > 0")
    r = cells.agg(F.max("w").alias("most"), (2 * F.sum("w")).alias("sum"), F.bool_and(F.col("w") == F.rint("w")).alias("whole")).first()
    if r["most"] is None:
        raise ValueError("no edge of positive weight")
    if r["whole"] and r["sum"] <= total:
        return cells.select("src", "dst", F.col("w").cast("long").alias("w")), 1.0
    scale = min(1.0 / (resolution * r["most"]), total / r["sum"])
    out = cells.select("src", "dst", F.rint(F.col("w") * scale).cast("long").alias("w"), F.col("w").alias("_w"))
    kept = out.agg((2 * F.sum("w")).alias("sum"), F.sum(F.when(F.col("w") == 0, F.col("_w")).otherwise(0.0)).alias("lost"), F.sum("_w").alias("all")).first()
    if kept["sum"] > total:
        raise OverflowError("the weights' sum is beyond the total")
    if kept["lost"] > resolution * kept["all"]:
        raise ValueError("rounding would lose too much weight")
    return out.select("src", "dst", "w"), scale


def dual_adjusted(edges: DataFrame, node_duals: DataFrame, pair_duals: DataFrame) -> DataFrame:
    """Weights less m times the duals of their ends and pair."""
    d = node_duals.select("node", "value")
    rows = edges.join(d.select(F.col("node").alias("src"), F.col("value").alias("x")), "src", "left").join(d.select(F.col("node").alias("dst"), F.col("value").alias("y")), "dst", "left")
    p = pair_duals.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), F.col("value").alias("p")).groupBy("src", "dst").agg(F.sum("p").alias("p"))
    z = F.lit(0.0)
    return rows.join(p, ["src", "dst"], "left").crossJoin(F.broadcast(volume(edges))).select("src", "dst", (F.col("w") - F.col("m") * ((F.coalesce("x", z) + F.coalesce("y", z)) / 2 + F.coalesce("p", z) / 2)).alias("w"))


def find_core(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """One row core_is: of labels 0 and 1 (node, c) the one that fits a core better."""
    one = be_score(edges, sides).select(F.col("score").alias("one"))
    zero = be_score(edges, sides.select("node", (1 - F.col("c")).alias("c"))).select(F.col("score").alias("zero"))
    return one.crossJoin(zero).select(F.when(F.col("zero") > F.col("one"), 0).otherwise(1).alias("core_is"))


def find_core_advanced(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(label, score): the label that fits best as the periphery, all others being core; the smallest of ties. One pass over the edges:
    an edge is in no core pair for a label only if both its ends have it."""
    e = edges.filter("src <> dst")
    a, b = membership.select(F.col("node").alias("src"), F.col("community").alias("x")), membership.select(F.col("node").alias("dst"), F.col("community").alias("y"))
    on = e.join(a, "src").join(b, "dst")
    total = on.agg(F.sum("w").alias("sa"), F.sum(F.col("w") * F.col("w")).alias("saa"))
    inner = on.filter("x = y").groupBy(F.col("x").alias("label")).agg(F.sum("w").alias("own"))
    size = membership.groupBy(F.col("community").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = size.join(inner, "label", "left").crossJoin(F.broadcast(total)).withColumn("t", F.sum("n").over(Window.partitionBy()))
    pairs = F.col("t") * (F.col("t") - 1) / 2
    sd = pairs - F.col("n") * (F.col("n") - 1) / 2
    cov = F.col("sa") - F.coalesce("own", F.lit(0.0)) - F.col("sa") * sd / pairs
    va, vd = F.col("saa") - F.col("sa") * F.col("sa") / pairs, sd - sd * sd / pairs
    score = F.when((va > 1e-12) & (vd > 1e-12), cov / F.sqrt(F.when((va > 1e-12) & (vd > 1e-12), va * vd).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0))
    return rows.select("label", F.round(score, 12).alias("score")).orderBy(F.desc("score"), "label").limit(1)


def power_iteration(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, x): the adjacency's principal eigenvector, scaled to a largest entry of 1 each round."""
    s = both_ways(edges)
    x = s.select(F.col("src").alias("node")).distinct().withColumn("x", F.lit(1.0))
    for _ in range(rounds):
        y = s.join(x.select(F.col("node").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        x = cut(y.withColumn("x", F.col("x") / F.max("x").over(Window.partitionBy())), "power")
    return x


def label_by_mixture(shares: DataFrame) -> DataFrame:
    """(node, label): the largest share's community, -1 for the lower of two Gaussian groups of largest shares."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    top = shares.groupBy("node").agg(F.max("share").alias("top"))
    rows = VectorAssembler(inputCols=["top"], outputCol="features").transform(top)
    model = GaussianMixture(k=2, seed=42).fit(rows)
    means = [float(r["mean"][0]) for r in model.gaussiansDF.collect()]
    low = means.index(min(means))
    weak = model.transform(rows).filter(F.col("prediction") == low).select("node", F.lit(True).alias("weak"))
    return label_by_threshold(shares, 0.0).join(weak, "node", "left").select("node", F.when(F.col("weak"), F.lit(-1)).otherwise(F.col("label")).cast("long").alias("label"))


def orbits(spark: SparkSession, a: np.ndarray, colors: np.ndarray | None = None) -> DataFrame:
    """(node, orbit): the smallest node that an automorphism takes a node to, exactly, by backtracking on a small graph."""
    n = len(a)
    colors = np.zeros(n, int) if colors is None else colors
    key = [(colors[i], a[i, i], tuple(sorted(np.round(a[i], 9)))) for i in range(n)]

    def maps(i: int, j: int) -> bool:
        order = [i, *[x for x in range(n) if x != i]]
        b = a[np.ix_(order, order)]
        ks = [key[x] for x in order]

        def go(image: list[int]) -> bool:
            p = len(image)
            if p == n:
                return True
            return any(y not in image and ks[p] == key[y] and all(abs(b[p, x] - a[y, z]) < 1e-9 for x, z in enumerate(image)) and go([*image, y]) for y in (range(n) if p else [j]))

        return go([])

    rep = [min(j for j in range(n) if j == i or maps(i, j)) for i in range(n)]
    return spark.createDataFrame([(i, int(r)) for i, r in enumerate(rep)], "node bigint, orbit bigint")
