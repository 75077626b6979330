"""Orbits of a weighted, vertex-colored graph under its automorphisms, exactly, by individualisation and refinement over tables.

Colors are refined by sums of hashed (weight, neighbour's color) pairs, so a hub is combined before it shuffles. Nodes of unlike refined
colors lie in different orbits. For nodes of one color a search asks for an automorphism that takes u to v: a branch names images for some
nodes, colors are refined on both sides at once with these marked, and unlike counts of a color end the branch. Branches of many pairs are
rows and take a step together. A found map is checked edge by edge, so a clash of hashes can't make one; clashes only merge colors, which
costs branches but no result. Every map found joins orbits of all nodes, and pairs of one orbit aren't searched again.

The search is exponential at worst, as that for any known exact method is. Places within a color are numbered by a window over its nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partflow.functions.storage import cut, release
from partflow.operators.components import connected_components
from partflow.sources.graphs import both_ways

ROUNDS = 2


def _mix(df: DataFrame, arcs: DataFrame, keys: list[str]) -> DataFrame:
    """Colors (keys, node, color) after a round."""
    near = arcs.join(df.select(*keys, F.col("node").alias("dst"), F.col("color").alias("c")), "dst")
    term = F.pmod(F.xxhash64("bucket", "c"), F.lit(1 << 40))
    sums = near.groupBy(*keys, F.col("src").alias("node")).agg(F.sum(term).alias("s"), F.count(F.lit(1)).alias("k"))
    return df.join(sums, [*keys, "node"], "left").select(*keys, "node", F.xxhash64("color", F.coalesce("s", F.lit(0)), F.coalesce("k", F.lit(0))).alias("color"))


def refine(arcs: DataFrame, base: DataFrame) -> DataFrame:
    """(node, color): base colors refined until their number stays; colors are hashes."""
    colors = cut(base.select("node", F.xxhash64("color").alias("color")), "colors")
    n = colors.select("color").distinct().count()
    while True:
        old, colors = colors, cut(_mix(colors, arcs, []), "colors")
        release(old)
        k = colors.select("color").distinct().count()
        if k <= n:
            return colors
        n = k


def _step(arcs: DataFrame, base: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(maps found: pair, node, image; branches that follow: pair, path) of the branches `tops` (pair, path of structs l, r)."""
    spread = tops.crossJoin(F.broadcast(tops.sparkSession.createDataFrame([("l",), ("r",)], "side string"))).select("pair", "side", F.transform("path", lambda p: F.when(F.col("side") == "l", p["l"]).otherwise(p["r"])).alias("marks"))
    marks = spread.select("pair", "side", F.posexplode("marks").alias("at", "node"))
    # the table of all nodes a branch: branches are few at a time, and their number is a parameter
    rows = base.crossJoin(F.broadcast(spread.select("pair", "side"))).join(marks, ["pair", "side", "node"], "left")
    colors = rows.select("pair", "side", "node", F.xxhash64("color", F.coalesce("at", F.lit(-1))).alias("color"))
    for _ in range(ROUNDS):
        colors = _mix(colors, arcs, ["pair", "side"])
    colors = cut(colors, "branch")
    left = F.col("side") == "l"
    cells = colors.groupBy("pair", "color").agg(F.count(F.when(left, 1)).alias("nl"), F.count(F.when(~left, 1)).alias("nr"), F.min(F.when(left, F.col("node"))).alias("first"))
    fits = cells.groupBy("pair").agg(F.bool_and(F.col("nl") == F.col("nr")).alias("fits"), F.min(F.when(F.col("nl") > 1, F.struct("nl", "first", "color"))).alias("cell")).filter("fits")
    fits = cut(fits.select("pair", "cell"), "fits")
    if fits.isEmpty():
        return colors.select("pair", "node", F.col("node").alias("image")).limit(0), tops.limit(0)
    place = F.row_number().over(Window.partitionBy("pair", "side", "color").orderBy("node"))
    placed = colors.join(fits.select("pair"), "pair", "left_semi").withColumn("place", place)
    maps = placed.filter("side = 'l'").join(placed.filter("side = 'r'").select("pair", "color", "place", F.col("node").alias("image")), ["pair", "color", "place"]).select("pair", "node", "image")
    maps = cut(maps, "placed")
    a, b = maps.select("pair", F.col("node").alias("src"), F.col("image").alias("x")), maps.select("pair", F.col("node").alias("dst"), F.col("image").alias("y"))
    moved = arcs.join(a, "src").join(b, ["pair", "dst"]).select("pair", F.col("x").alias("src"), F.col("y").alias("dst"), "bucket")
    bad = moved.join(arcs, ["src", "dst", "bucket"], "left_anti").select("pair")
    recolored = maps.join(base, "node").join(base.select(F.col("node").alias("image"), F.col("given").alias("g2")), "image").filter("given <> g2").select("pair")
    bad = cut(bad.unionByName(recolored).distinct(), "bad")
    found = cut(maps.join(bad, "pair", "left_anti"), "found")
    open_ = fits.join(bad, "pair", "left_semi").filter("cell is not null").select("pair", F.col("cell.first").alias("l"), F.col("cell.color").alias("color"))
    images = open_.join(colors.filter("side = 'r'").select("pair", "color", F.col("node").alias("r")), ["pair", "color"])
    after = images.join(tops, "pair").select("pair", F.concat("path", F.array(F.struct("l", "r"))).alias("path"))
    return found, cut(after, "after")


def automorphisms(arcs: DataFrame, base: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, node, image): for pairs (pair, u, v) an automorphism that takes u to v, of all nodes, where there is one. Depth first per pair."""
    stack = cut(pairs.select("pair", F.array(F.struct(F.col("u").alias("l"), F.col("v").alias("r"))).alias("path")), "stack")
    out = None
    while not stack.isEmpty():
        order = F.struct(F.size("path").alias("deep"), (-F.col("path")[F.size("path") - 1]["r"]).alias("r"), "path")
        tops = cut(stack.groupBy("pair").agg(F.max(order).alias("t")).select("pair", F.col("t.path").alias("path")), "tops")
        found, after = _step(arcs, base, tops)
        out = found if out is None else out.unionByName(found)
        rest = stack.join(tops, ["pair", "path"], "left_anti").unionByName(after)
        old, stack = stack, cut(rest.join(found.select("pair").distinct(), "pair", "left_anti"), "stack")
        release(old, tops, after)
    return out if out is not None else pairs.select("pair", F.col("u").alias("node"), F.col("v").alias("image"))


def orbits(edges: DataFrame, nodes: DataFrame, colors: DataFrame | None = None, tolerance: float = 1e-9, batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """((node, orbit): an orbit is named by its smallest node; the maps (node, image) that prove it, a few automorphisms one after another in column
    `map`). Weights are equal if they round to the same multiple of `tolerance`; near-whole ones become whole. colors: (node, color), a
    node without one has none; null ends drop an edge. `batch` pairs are searched at a time."""
    w = F.when(F.abs(F.col("w") - F.rint("w")) <= tolerance, F.rint("w") / tolerance).otherwise(F.col("w") / tolerance)
    arcs = both_ways(edges.filter("src is not null and dst is not null")).select("src", "dst", F.rint(w).alias("bucket"))
    # parallel edges are a multiset, told by their sorted buckets
    arcs = cut(arcs.groupBy("src", "dst").agg(F.sort_array(F.collect_list("bucket")).cast("string").alias("bucket")), "arcs")
    given = nodes.select("node").distinct()
    if colors is not None:
        given = given.join(colors.select("node", F.col("color").cast("string").alias("given")), "node", "left").select("node", F.concat(F.lit("c"), "given").alias("given"))
    else:
        given = given.withColumn("given", F.lit(""))
    given = cut(given.select("node", F.coalesce("given", F.lit("")).alias("given")), "given")
    refined = refine(arcs, given.select("node", F.col("given").alias("color")))
    base = cut(given.join(refined, "node"), "base")
    comp = cut(base.select("node", F.col("node").alias("component")), "orbits")
    maps, unlike, leaders, turn = None, None, None, 0
    while True:
        reps = comp.filter("node = component").join(base, "node").select("node", "color")
        settled = reps.groupBy("color").agg(F.min("node").alias("node"))
        if leaders is not None:
            settled = settled.select("node").unionByName(leaders).distinct().join(reps, "node")
        settled = cut(settled.select("node", "color"), "settled")
        open_ = reps.join(settled.select("node"), "node", "left_anti")
        pairs = open_.select(F.col("node").alias("v"), "color").join(settled.select(F.col("node").alias("u"), "color"), "color").select("u", "v")
        if unlike is not None:
            pairs = pairs.join(unlike, ["u", "v"], "left_anti")
        pairs = cut(pairs, "pairs")
        # what is unlike every settled node of its color leads an orbit of its own, one a color and round
        new = cut(open_.join(pairs.select(F.col("v").alias("node")), "node", "left_anti").groupBy("color").agg(F.min("node").alias("node")).select("node"), "leaders")
        leaders = new if leaders is None else leaders.unionByName(new)
        if pairs.isEmpty():
            if new.isEmpty():
                break
            continue
        some = cut(pairs.groupBy("v").agg(F.min("u").alias("u")).orderBy("v").limit(batch).select("u", "v", F.col("v").alias("pair")), "some")
        found = automorphisms(arcs, base, some)
        turn += 1
        failed = cut(some.join(found.select("pair").distinct(), "pair", "left_anti").select("u", "v"), "unlike")
        unlike = failed if unlike is None else unlike.unionByName(failed)
        new_maps = cut(found.select(F.concat_ws(":", F.lit(str(turn)), F.col("pair").cast("string")).alias("map"), "node", "image"), "maps")
        maps = new_maps if maps is None else maps.unionByName(new_maps)
        moved = maps.filter("node <> image").select(F.col("node").alias("u"), F.col("image").alias("v")).unionByName(base.select(F.col("node").alias("u"), F.col("node").alias("v")))
        comp = cut(connected_components(moved), "orbits")
    if maps is None:
        maps = base.select(F.lit("0").alias("map"), "node", F.col("node").alias("image"))
    return comp.select("node", F.col("component").alias("orbit")), maps
