"""Shortest paths over an edge table: betweenness by frontiers, nearest seeds by relaxation, Voronoi communities.

A frontier or relaxation is a table of (source, node) rows; a round is one join with the arcs and one aggregation, so nothing but the number
of rounds depends on how long paths are. Sources go in batches, so that their rows stay a bounded multiple of the nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partflow.functions.storage import cut, release
from partflow.sources.graphs import both_ways

ROWS = 50_000_000  #: (source, node) rows of a batch of sources, about


def _arcs(edges: DataFrame) -> DataFrame:
    return both_ways(edges.filter("src <> dst")).select("src", "dst").distinct()


def _forward(arcs: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Per level (s, t, paths): the nodes that many steps from a source and how many shortest paths lead there."""
    levels = [cut(sources.select(F.col("node").alias("s"), F.col("node").alias("t"), F.lit(1.0).alias("paths")), "level")]
    seen = cut(levels[0].select("s", "t"), "seen")
    while True:
        step = levels[-1].join(arcs, F.col("t") == F.col("src")).groupBy("s", "dst").agg(F.sum("paths").alias("paths")).select("s", F.col("dst").alias("t"), "paths")
        front = cut(step.join(seen, ["s", "t"], "left_anti"), "level")
        if front.isEmpty():
            release(seen, front)
            return levels
        levels.append(front)
        old, seen = seen, cut(seen.unionByName(front.select("s", "t")), "seen")
        release(old)


def _backward(arcs: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """Per level (src, dst, part): what the levels' nodes owe to the edges before them."""
    parts, owed = [], None
    for near, far in zip(levels[-2::-1], levels[:0:-1], strict=True):
        here = far.join(owed, ["s", "t"], "left") if owed is not None else far.withColumn("owed", F.lit(0.0))
        here = here.select("s", "t", (((1 + F.coalesce("owed", F.lit(0.0))) / F.col("paths"))).alias("each"))
        before = near.select("s", F.col("t").alias("p"), F.col("paths").alias("paths_p"))
        rows = here.join(arcs, F.col("t") == F.col("src")).select("s", "t", F.col("dst").alias("p"), "each").join(before, ["s", "p"])
        rows = cut(rows.select("s", "t", "p", (F.col("paths_p") * F.col("each")).alias("part")), "parts")
        parts.append(rows.select(F.least("t", "p").alias("src"), F.greatest("t", "p").alias("dst"), "part"))
        owed = rows.groupBy("s", F.col("p").alias("t")).agg(F.sum("part").alias("owed"))
    return parts


def edge_betweenness(edges: DataFrame, rows: int = ROWS) -> DataFrame:
    """(src, dst, betweenness): the share of shortest paths (unweighted) over each edge, each pair of nodes once.

    Path counts go forward level by level, dependencies backward; an edge that no path takes can't be, so every edge has its row."""
    arcs = cut(_arcs(edges), "arcs")
    nodes = cut(arcs.select(F.col("src").alias("node")).distinct(), "nodes")
    n = nodes.count()
    batches = max(1, -(-n * n // rows))
    total = None
    for k in range(batches):
        levels = _forward(arcs, nodes.filter(F.pmod(F.xxhash64("node"), F.lit(batches)) == k))
        parts = _backward(arcs, levels)
        if parts:
            some = reduce(DataFrame.unionByName, parts).groupBy("src", "dst").agg((F.sum("part") / 2).alias("betweenness"))
            old, total = total, cut(some if total is None else total.unionByName(some).groupBy("src", "dst").agg(F.sum("betweenness").alias("betweenness")), "betweenness")
            release(old)
        release(*levels)
    return total if total is not None else arcs.select("src", "dst", F.lit(0.0).alias("betweenness")).limit(0)


def best_cut(edges: DataFrame) -> DataFrame:
    """One row: the edge a Girvan-Newman step removes, of most betweenness, ties to the smallest."""
    return edge_betweenness(edges).withColumn("betweenness", F.round("betweenness", 6)).orderBy(F.desc("betweenness"), "src", "dst").limit(1)


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c by (degree, id): each triangle once. Edges point to the end of higher degree, so that no node, however
    many neighbours it has, opens more pairs than there are edges to nodes of higher degree."""
    e = edges.filter("src <> dst").select("src", "dst")
    k = _arcs(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    e = e.join(k.select(F.col("node").alias("src"), F.col("k").alias("ks")), "src").join(k.select(F.col("node").alias("dst"), F.col("k").alias("kd")), "dst")
    low, high = F.struct(F.col("ks").alias("k"), F.col("src").alias("n")), F.struct(F.col("kd").alias("k"), F.col("dst").alias("n"))
    up = cut(e.select(F.when(low < high, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(low < high, F.col("dst")).otherwise(F.col("src")).alias("y"), F.greatest(low, high).alias("top")), "up")
    one, two = up.select("x", F.col("y").alias("b"), F.col("top").alias("tb")), up.select("x", F.col("y").alias("c"), F.col("top").alias("tc"))
    wedge = one.join(two, "x").filter("tb < tc").select(F.col("x").alias("a"), "b", "c")
    return wedge.join(up.select(F.col("x").alias("b"), F.col("y").alias("c")), ["b", "c"]).select("a", "b", "c")


def edge_lengths(edges: DataFrame) -> DataFrame:
    """(src, dst, length): (smaller degree - 1) / (triangles on the edge + 1), short where neighbours are shared."""
    k = _arcs(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    corners = triangles(edges).select(F.explode(F.array(*[F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])).alias("e"))
    on = corners.groupBy("e.src", "e.dst").agg(F.count(F.lit(1)).alias("t"))
    e = edges.filter("src <> dst").select("src", "dst").join(on, ["src", "dst"], "left")
    e = e.join(k.select(F.col("node").alias("src"), F.col("k").alias("ks")), "src").join(k.select(F.col("node").alias("dst"), F.col("k").alias("kd")), "dst")
    return e.select("src", "dst", F.round((F.least("ks", "kd") - 1) / (F.coalesce("t", F.lit(0)) + 1), 9).alias("length"))


def local_density(edges: DataFrame) -> DataFrame:
    """(node, density): strength times the share of the weight at a node and its neighbours that stays among them."""
    e = edges.filter("src <> dst")
    arcs = both_ways(e)
    a = arcs.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("a"))
    t = triangles(edges)
    sides = t.select(F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.least(y, z).alias("src"), F.greatest(y, z).alias("dst")) for x, y, z in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b"))])).alias("s")).select("s.*")
    opposite = sides.join(e.select("src", "dst", "w"), ["src", "dst"]).groupBy("node").agg(F.sum("w").alias("opposite"))
    around = arcs.join(a.select(F.col("node").alias("dst"), F.col("a").alias("b")), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("b").alias("b"))
    rows = a.join(around, "node").join(opposite, "node", "left")
    inside, touching = 2 * (F.col("a") + F.coalesce("opposite", F.lit(0.0))), F.col("a") + F.col("b")
    return rows.select("node", F.round(inside / touching * F.col("a"), 9).alias("density"))


def nearest_seed(lengths: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, seed, dist) of every node that a seed reaches: the nearest one, the smallest of ties. A round relaxes the arcs out of the nodes
    that changed in the last."""
    arcs = cut(both_ways(lengths.select("src", "dst", F.col("length").alias("w"))), "arcs")
    state = cut(seeds.select("node", F.struct(F.lit(0.0).alias("dist"), F.col("node").alias("seed")).alias("best")), "state")
    fresh = state
    while True:
        offers = fresh.join(arcs, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.struct(F.round(F.col("best.dist") + F.col("w"), 9).alias("dist"), F.col("best.seed").alias("seed"))).alias("offer"))
        better = offers.join(state, "node", "left").filter(F.col("best").isNull() | (F.col("offer") < F.col("best")))
        new = cut(better.select("node", F.col("offer").alias("best")), "fresh")
        if new.isEmpty():
            return state.select("node", F.col("best.seed").alias("seed"), F.col("best.dist").alias("dist"))
        old, state = state, cut(state.join(new.select("node"), "node", "left_anti").unionByName(new), "state")
        release(old, *([] if fresh is old else [fresh]))
        fresh = new


def balls(lengths: DataFrame, radius: float) -> DataFrame:
    """(u, v): the ordered pairs of different nodes at most a radius apart."""
    arcs = cut(both_ways(lengths.select("src", "dst", F.col("length").alias("w"))).filter(F.col("w") <= radius), "arcs")
    known = cut(arcs.groupBy(F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.min("w").alias("d")), "balls")
    fresh = known
    while True:
        step = fresh.join(arcs, F.col("v") == F.col("src")).select("u", F.col("dst").alias("v"), F.round(F.col("d") + F.col("w"), 9).alias("d")).filter((F.col("d") <= radius) & (F.col("u") != F.col("v"))).groupBy("u", "v").agg(F.min("d").alias("d"))
        new = cut(step.join(known.select("u", "v", F.col("d").alias("_d")), ["u", "v"], "left").filter("_d is null or d < _d").select("u", "v", "d"), "fresh")
        if new.isEmpty():
            return known.select("u", "v")
        old, known = known, cut(known.join(new.select("u", "v"), ["u", "v"], "left_anti").unionByName(new), "balls")
        release(old, *([] if fresh is old else [fresh]))
        fresh = new


def spread_seeds(ranks: DataFrame, near: DataFrame) -> DataFrame:
    """(node): nodes that a walk from the highest rank down takes if none taken is near. ranks: (node, rank), a higher one first, ties from the
    smallest node up. In each round all nodes go that outrank every open neighbour; their neighbours close."""
    open_ = cut(ranks.select("node", F.struct("rank", (-F.col("node")).alias("tie")).alias("r")), "open")
    near = cut(near.select("u", "v"), "near")
    taken = None
    while not open_.isEmpty():
        rival = near.join(open_.select(F.col("node").alias("v"), F.col("r").alias("q")), "v").groupBy(F.col("u").alias("node")).agg(F.max("q").alias("q"))
        new = cut(open_.join(rival, "node", "left").filter("q is null or r > q").select("node"), "taken")
        closed = new.unionByName(near.join(new.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node"))).distinct()
        old, open_ = open_, cut(open_.join(closed, "node", "left_anti"), "open")
        release(old)
        taken = new if taken is None else taken.unionByName(new)
    return taken if taken is not None else ranks.select("node").limit(0)


def voronoi(edges: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """(node, community): seeds are the densest nodes that lie more than a radius apart, every node goes to its nearest seed, by lengths that are
    small inside clusters; a node that no seed reaches is alone."""
    lengths = cut(edge_lengths(edges), "lengths")
    seeds = spread_seeds(local_density(edges).select("node", F.col("density").alias("rank")), balls(lengths, radius))
    found = nearest_seed(lengths, seeds)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("seed", "node").alias("community"))


def shortest_first(pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v, d) those that are each other's nearest: d is the least at both ends, ties to the smallest pair."""
    key = F.struct("d", "u", "v")
    both = pairs.select(F.explode(F.array("u", "v")).alias("node"), key.alias("key")).groupBy("node").agg(F.min("key").alias("key"))
    return both.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k = 2").select("key.u", "key.v", "key.d")


def walktrap(edges: DataFrame, nodes: DataFrame, steps: int = 4, rounds: int | None = None, relative: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """((node, community), the membership after each round). Linked communities whose walks of a few steps are most alike, by Ward's distance,
    are joined: in a round all pairs that are each other's nearest, which is what joining one pair at a time comes to where distances to a
    merged community don't fall below those of its parts. Walks are sparse rows (community, end, p / sqrt(degree of the end)). Distances are
    compared to 9 digits and fall as weights rise; with `relative` degrees are shares of their mean, so that the weights' unit doesn't matter."""
    from partflow.operators.community import random_walk

    arcs = both_ways(edges.filter("src <> dst"))
    a = arcs.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("a"))
    if relative:
        a = a.crossJoin(F.broadcast(a.agg(F.avg("a").alias("mean")))).select("v", (F.col("a") / F.col("mean")).alias("a"))
    walk = cut(random_walk(edges.filter("src <> dst"), steps).join(a, "v").select(F.col("u").alias("c"), "v", (F.col("p") / F.sqrt("a")).alias("x")), "walk")
    links = cut(edges.filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), "links")
    membership = cut(nodes.select("node", F.col("node").alias("community")), "membership")
    size = cut(membership.groupBy(F.col("community").alias("c")).agg(F.count(F.lit(1)).alias("n")), "size")
    levels: list[DataFrame] = []
    while not links.isEmpty() and (rounds is None or len(levels) < rounds):
        square = walk.groupBy("c").agg(F.sum(F.col("x") * F.col("x")).alias("q"))
        each = cut(size.join(square, "c", "left"), "each")
        dot = links.join(walk.select(F.col("c").alias("u"), F.col("v").alias("end"), F.col("x").alias("xu")), "u").join(walk.select(F.col("c").alias("v"), F.col("v").alias("end"), F.col("x").alias("xv")), ["v", "end"])
        dot = dot.groupBy("u", "v").agg(F.sum(F.col("xu") * F.col("xv")).alias("dot"))
        far = links.join(dot, ["u", "v"], "left")
        for side in ("u", "v"):
            far = far.join(each.select(F.col("c").alias(side), F.col("q").alias(f"q{side}"), F.col("n").alias(f"n{side}")), side)
        z = F.lit(0.0)
        ward = F.col("nu") * F.col("nv") / (F.col("nu") + F.col("nv")) * (F.coalesce("qu", z) + F.coalesce("qv", z) - 2 * F.coalesce("dot", z))
        merges = cut(shortest_first(far.select("u", "v", F.round(ward, 9).alias("d"))), "merges")
        into = merges.select(F.col("v").alias("c"), F.col("u").alias("to"))
        moved = walk.join(size, "c").join(into, "c", "left").select(F.coalesce("to", "c").alias("c"), "v", (F.col("x") * F.col("n")).alias("y"))
        new_size = cut(size.join(into, "c", "left").groupBy(F.coalesce("to", "c").alias("c")).agg(F.sum("n").alias("n")), "size")
        new_walk = cut(moved.groupBy("c", "v").agg(F.sum("y").alias("y")).join(new_size, "c").select("c", "v", (F.col("y") / F.col("n")).alias("x")), "walk")
        renamed = links
        for side in ("u", "v"):
            renamed = renamed.join(into.select(F.col("c").alias(side), F.col("to").alias(f"t{side}")), side, "left").withColumn(side, F.coalesce(f"t{side}", side)).drop(f"t{side}")
        new_links = cut(renamed.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
        membership = cut(membership.join(into.select(F.col("c").alias("community"), "to"), "community", "left").select("node", F.coalesce("to", "community").alias("community")), "membership")
        release(walk, size, links, merges, each)
        walk, size, links = new_walk, new_size, new_links
        levels.append(membership)
    return membership, levels
