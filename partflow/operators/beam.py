"""Balanced columns by a beam search whose partial assignments are rows.

Every run is an order of blocks with a seed. A step takes each run's next block, extends all partial assignments of all runs at once by every
community that sizes and cannot-links allow, and keeps of a state its `branch` cheapest extensions and of a run the `width` cheapest states.
A step sees width * branch rows a run, whatever the graph; a run's steps are as many as its blocks, so blocks come from contraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partflow.functions.storage import cut, release

#: What a step costs: a gap in the order since the community's last block, a change of community, distance from the even size.
CONTIGUITY, SWITCH, TARGET = 4, 3, 2
EVERY = 4


def jitter(pos, group, seed, noise: int):
    """A fixed pseudo-random whole number in 0..noise; the same form in SQL gives the same numbers."""
    return ((pos * 7919 + group * 104729 + seed * 1299709) % 1000003) % (noise + 1)


def runs(orders: DataFrame, sizes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(run, seed, pos, node, size, left, against) from orders (run, seed, node, pos): positions count from 0, `left` is the size of what comes later,
    `against` has the earlier positions that a cannot-link (u, v) keeps apart from this one."""
    line = Window.partitionBy("run").orderBy("pos", "node")
    rows = orders.join(sizes.select("node", "size"), "node").withColumn("_p", F.row_number().over(line) - 1)
    rows = rows.withColumn("left", F.sum("size").over(Window.partitionBy("run")) - F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = cut(rows.select("run", "seed", F.col("_p").cast("long").alias("pos"), "node", F.col("size").cast("long").alias("size"), F.col("left").cast("long").alias("left")), "runs")
    both = conflicts.select("u", "v").unionByName(conflicts.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    pairs = both.join(rows.select("run", F.col("node").alias("u"), "pos"), "u").join(rows.select("run", F.col("node").alias("v"), F.col("pos").alias("other")), ["run", "v"])
    against = pairs.filter("other < pos").groupBy("run", "pos").agg(F.sort_array(F.collect_set("other")).alias("against"))
    return cut(rows.join(against, ["run", "pos"], "left").withColumn("against", F.coalesce("against", F.expr("array()").cast("array<bigint>"))), "runs")


def extend(states: DataFrame, step: DataFrame, k: int, low: int, high: int, total: int, width: int, branch: int, noise: int) -> DataFrame:
    """The states (run, cost, labels, held, last) after the block of `step` (one row a run)."""
    g = F.col("g")
    rows = states.join(step, "run").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    held = F.element_at("held", (g + 1).cast("int"))
    size = F.col("size")
    after = F.transform("held", lambda x, i: F.when(i == g, x + size).otherwise(x))
    # only the first empty community is opened: the others would give the same partition
    opened = F.size(F.filter("held", lambda x: x > 0))
    rows = rows.filter((g <= opened) & (held + size <= high) & ~F.exists("against", lambda p: F.element_at("labels", (p + 1).cast("int")) == g))
    lacking = F.aggregate(after, F.lit(0).cast("long"), lambda t, x: t + F.greatest(F.lit(low) - x, F.lit(0).cast("long")))
    room = F.aggregate(after, F.lit(0).cast("long"), lambda t, x: t + F.lit(high) - x)
    rows = rows.filter((lacking <= F.col("left")) & (F.col("left") <= room))
    seen = F.element_at("last", (g + 1).cast("int"))
    gap = F.when(held > 0, F.col("pos") - 1 - seen).otherwise(F.lit(0).cast("long"))
    switch = F.when((F.col("pos") > 0) & (F.try_element_at("labels", F.lit(-1)) != g), 1).otherwise(0)
    even = F.abs(k * (held + size) - total) - F.abs(k * held - total)
    cost = CONTIGUITY * gap + SWITCH * switch + TARGET * even + jitter(F.col("pos"), g, F.col("seed"), noise)
    new = rows.select("run", "labels", F.col("g"), (F.col("cost") + cost).alias("cost"), after.alias("held"), F.transform("last", lambda x, i: F.when(i == g, F.col("pos")).otherwise(x)).alias("last"))
    few = new.withColumn("_r", F.row_number().over(Window.partitionBy("run", "labels").orderBy("cost", "g"))).filter(F.col("_r") <= branch)
    few = few.select("run", "cost", F.concat("labels", F.array("g")).alias("labels"), "held", "last")
    return few.withColumn("_r", F.row_number().over(Window.partitionBy("run").orderBy("cost", "labels"))).filter(F.col("_r") <= width).drop("_r")


def search(line: DataFrame, k: int, low: int, high: int, width: int = 8, branch: int = 6, noise: int = 0) -> DataFrame:
    """(run, cost, labels): the complete assignments that are left, labels by position; none for a run whose beam dies out."""
    spark = line.sparkSession
    shape = line.agg(F.max("pos").alias("last")).first()["last"]
    empty = F.array_repeat(F.lit(0).cast("long"), k)
    states = line.groupBy("run").agg(F.max("size").alias("_")).select("run", F.lit(0).cast("long").alias("cost"), F.expr("array()").cast("array<bigint>").alias("labels"), empty.alias("held"), empty.alias("last"))
    if shape is None:
        return states.select("run", "cost", "labels")
    total = line.filter(F.col("pos") == 0).agg(F.max(F.col("left") + F.col("size")).alias("n")).first()["n"]
    kept = None
    for p in range(shape + 1):
        states = extend(states, line.filter(F.col("pos") == p).select("run", "seed", "pos", "size", "left", "against"), k, low, high, total, width, branch, noise)
        if p % EVERY == EVERY - 1 or p == shape:
            old, kept = kept, cut(states, "beam")
            release(old)
            states = spark.read.schema(kept.schema).parquet(kept.cut_path)
    return kept.select("run", "cost", "labels")


def columns(orders: DataFrame, blocks: DataFrame, conflicts: DataFrame, k: int, low: int, high: int, width: int = 8, branch: int = 6, noise: int = 0, tries: int = 3) -> DataFrame:
    """(run, node, block, community): the cheapest assignment of every run, each partition once (the smallest run keeps it). blocks: (node, block); orders:
    (run, seed, node, pos) over blocks; conflicts: (u, v) of blocks. A run whose beam dies out starts again with twice the width, `tries` times in
    all; what still has none is left out. Communities are 0.. in the order in which a run meets them."""
    if k < 1 or low < 0 or high < low:
        raise ValueError("k, low and high must be in order")
    sizes = cut(blocks.groupBy(F.col("block").alias("node")).agg(F.count(F.lit(1)).alias("size")), "sizes")
    if not conflicts.filter("u = v").limit(1).isEmpty():
        raise ValueError("a cannot-link lies inside a block")
    line = runs(orders, sizes, conflicts)
    rest, done = line, None
    for _ in range(tries):
        full = search(rest, k, low, high, width, branch, noise)
        best = full.groupBy("run").agg(F.min(F.struct("cost", "labels")).alias("b")).select("run", F.col("b.cost").alias("cost"), F.col("b.labels").alias("labels"))
        best = cut(best, "best")
        done = best if done is None else done.unionByName(best)
        rest = cut(rest.join(best.select("run"), "run", "left_anti"), "rest")
        if rest.isEmpty():
            break
        width *= 2
    given = done.select("run", F.posexplode("labels").alias("pos", "community")).join(line.select("run", "pos", F.col("node").alias("block")), ["run", "pos"]).select("run", "block", "community")
    given = cut(given, "given")
    named = given.withColumn("name", F.min("block").over(Window.partitionBy("run", "community")))
    mark = named.groupBy("run").agg(F.bit_xor(F.xxhash64("block", "name")).alias("x"), F.bit_xor(F.xxhash64("name", "block", F.lit(1))).alias("y"))
    first = mark.groupBy("x", "y").agg(F.min("run").alias("run")).select("run")
    return given.join(first, "run", "left_semi").join(blocks, "block").select("run", "node", "block", "community")
