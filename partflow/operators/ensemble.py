"""Ensembles of clusterings: co-association shares of pairs, and blocks of nodes that a weighted combination of partitions treats alike.

Memberships are rows (run, node, community). A share is looked up for pairs that somebody asks about, the graph's edges by default, so a
community of any size costs its members' rows and never their pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partflow.functions.storage import cut, release
from partflow.sources.graphs import both_ways

WIDTH = 16  #: entries of a node's feature vector
METHODS = ("kmeans", "gmm", "power")


def features(edges: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, features): a node's row of the matrix, its diagonal 1, folded into `width` entries with hashed places and signs."""
    from pyspark.ml.functions import array_to_vector

    cells = both_ways(edges.filter("src <> dst")).select(F.col("src").alias("node"), F.col("dst").alias("at"), "w").unionByName(nodes.select("node", F.col("node").alias("at"), F.lit(1.0).alias("w")))
    h = F.xxhash64("at")
    sums = cells.groupBy("node").agg(*[F.sum(F.when(F.pmod(h, F.lit(width)) == k, F.col("w") * F.when(F.shiftrightunsigned(h, 40) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)).alias(f"f{k}") for k in range(width)])
    return nodes.select("node").join(sums, "node").select("node", array_to_vector(F.array(*[f"f{k}" for k in range(width)])).alias("features"))


def memberships(edges: DataFrame, nodes: DataFrame, counts: Sequence[int], seeds: Sequence[int], methods: Sequence[str] = METHODS, width: int = WIDTH) -> DataFrame:
    """(run, method, k, seed, node, community) of every clustering that can be made: k-means and Gaussian mixtures of the features, power
    iteration over the edges of positive weight. A number of clusters is cut to the number of different rows, and clusterings into one group
    are left out, as is power iteration over a graph that isn't in one piece (some nodes would have no community) and a mixture that fails."""
    from pyspark.ml.clustering import GaussianMixture, KMeans, PowerIterationClustering

    from partflow.operators.components import connected_components

    rows = cut(features(edges, nodes, width), "features")
    different = rows.select("features").distinct().count()
    positive = edges.filter("src <> dst and w > 0")
    pieces = connected_components(positive.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    whole = pieces.select("component").distinct().count() == 1 and pieces.count() == rows.count()
    out: list[DataFrame] = []
    for k in dict.fromkeys(min(c, different) for c in counts):
        if k <= 1:
            continue
        for seed in seeds:
            for method in methods:
                if method == "kmeans":
                    found = KMeans(k=k, seed=seed, maxIter=30).fit(rows).transform(rows).select("node", F.col("prediction").cast("long").alias("community"))
                elif method == "gmm":
                    found = GaussianMixture(k=k, seed=seed, maxIter=30).fit(rows).transform(rows).select("node", F.col("prediction").cast("long").alias("community"))
                elif method == "power":
                    if not whole:
                        continue
                    turn = PowerIterationClustering(k=k, maxIter=15, initMode="random" if seed % 2 == 0 else "degree", srcCol="src", dstCol="dst", weightCol="w")
                    found = turn.assignClusters(positive).select(F.col("id").alias("node"), F.col("cluster").cast("long").alias("community"))
                else:
                    raise ValueError(f"no clustering method {method!r}: one of {', '.join(METHODS)}")
                out.append(cut(found.select(F.lit(f"{method}-{k}-{seed}").alias("run"), F.lit(method).alias("method"), F.lit(k).alias("k"), F.lit(seed).alias("seed"), "node", "community"), "run"))
    if not out:
        raise ValueError("no clustering could be made")
    return reduce(DataFrame.unionByName, out)


def pair_shares(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, share): of all runs the share that has both ends of a pair (u, v) in one community; pairs that no run joins have 0."""
    runs = members.agg(F.countDistinct("run").alias("runs"))
    want = pairs.select(F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j")).filter("i <> j").distinct()
    a, b = members.select("run", F.col("node").alias("i"), F.col("community").alias("x")), members.select("run", F.col("node").alias("j"), F.col("community").alias("y"))
    met = want.join(a, "i").join(b, ["run", "j"]).filter("x = y").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    return want.join(met, ["i", "j"], "left").crossJoin(F.broadcast(runs)).select("i", "j", (F.coalesce("n", F.lit(0)) / F.col("runs")).alias("share"))


def alike(members: DataFrame, weights: DataFrame, decimals: int) -> DataFrame:
    """(node, bucket): nodes whose rows of the weighted co-association matrix, rounded half to even, are identical have one bucket.

    members: (part_id, node, community); weights: (part_id, weight), of which those of 0 don't count. Nodes with the same labels have the
    same row, so rows are made for distinct label lists only and over such lists, each entry for the lists that share a community. A row's
    name is the exclusive or of two hashes of its entries, which doesn't depend on their order."""
    used = members.join(weights.filter("weight <> 0"), "part_id")
    of = used.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("part_id", "community", "weight"))).alias("labels"))
    of = cut(of.select("node", F.sha2(F.to_json("labels"), 256).alias("whole"), "labels"), "lists")
    lists = of.groupBy("whole").agg(F.first("labels").alias("labels"))
    cells = cut(lists.select("whole", F.explode("labels").alias("l")).select("whole", "l.part_id", "l.community", "l.weight"), "cells")
    one, two = cells, cells.select(F.col("whole").alias("other"), "part_id", "community")
    entries = one.join(two, ["part_id", "community"]).groupBy("whole", "other").agg(F.bround(F.round(F.sum("weight"), 12), decimals).alias("z"))
    entries = entries.withColumn("z", F.when(F.col("whole") == F.col("other"), F.lit(1.0)).otherwise(F.col("z"))).filter("z <> 0")
    names = entries.groupBy("whole").agg(F.bit_xor(F.xxhash64("other", "z")).alias("x"), F.bit_xor(F.xxhash64("z", F.reverse("other"))).alias("y"))
    return of.select("node", "whole").join(names, "whole").select("node", F.concat_ws(":", "x", "y").alias("bucket"))


def first_fit(buckets: DataFrame, cannot: DataFrame) -> DataFrame:
    """(node, bucket, color): in ascending order each node takes the first color that no smaller node of its bucket that it must not meet has.

    A node waits for its smaller conflicting neighbours only, so a round colors all that wait for none; nodes without conflicts are done at
    once."""
    b = buckets.select("node", "bucket")
    pairs = cannot.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    inside = pairs.join(b.select(F.col("node").alias("u"), F.col("bucket").alias("bu")), "u").join(b.select(F.col("node").alias("v"), F.col("bucket").alias("bv")), "v").filter("bu = bv").select("u", "v")
    inside = cut(inside, "conflicts")
    done = cut(b.join(inside.select(F.col("v").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(0).alias("color")), "colors")
    left = cut(inside.select(F.col("v").alias("node")).distinct(), "left")
    while not left.isEmpty():
        known = inside.join(done.select(F.col("node").alias("u"), "color"), "u", "left").join(left.select(F.col("node").alias("v")), "v")
        ready = known.groupBy(F.col("v").alias("node")).agg(F.count_if(F.col("color").isNull()).alias("waits"), F.collect_set("color").alias("taken")).filter("waits = 0")
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), F.col("taken")))
        new = cut(ready.select("node", free.cast("int").alias("color")), "colors")
        rest = cut(left.join(new.select("node"), "node", "left_anti"), "left")
        release(left)
        left, done = rest, done.unionByName(new)
    return b.join(done, "node")


def fill_up(groups: DataFrame, keys: list[str], most: int, slice_: int = 100_000) -> DataFrame:
    """The rows of `groups` (node, size and the keys) with `part`: each group's nodes, largest first, ties by id, fill parts one after another;
    a node that would take a part beyond `most` opens the next.

    Nodes of one size fill parts by arithmetic, so a group is walked over its distinct sizes only; places among nodes of one size are counted
    in slices of ids, so a group of any size isn't one task's."""
    sizes = groups.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("n"))
    per = sizes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("runs"))

    def step(state, run):
        s, n = run["size"].cast("long"), run["n"]
        fits = F.greatest(F.floor((F.lit(most) - state["fill"]) / s).cast("long"), F.when(state["fill"] == 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))  # into the open part
        each = F.greatest(F.floor(F.lit(most) / s).cast("long"), F.lit(1).cast("long"))  # into an empty one
        more = F.greatest(n - fits, F.lit(0).cast("long"))
        opened = F.ceil(more / each).cast("long")
        last = F.when(more > 0, (more - (opened - 1) * each) * s).otherwise(state["fill"] + n * s)
        here = F.struct(s.alias("size"), state["part"].alias("part"), fits.alias("fits"), each.alias("each"))
        return F.struct((state["part"] + opened).alias("part"), last.cast("long").alias("fill"), F.concat(state["out"], F.array(here)).alias("out"))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("part"), zero.alias("fill"), F.array().cast("array<struct<size:bigint,part:bigint,fits:bigint,each:bigint>>").alias("out"))
    plans = per.select(*keys, F.explode(F.aggregate("runs", start, step)["out"]).alias("p")).select(*keys, "p.size", "p.part", "p.fits", "p.each")
    piece = F.floor(F.col("node") / slice_).alias("piece")
    counts = groups.groupBy(*keys, "size", piece).agg(F.count(F.lit(1)).alias("m"))
    before = counts.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy(*keys, "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), zero)).drop("m")
    rows = groups.withColumn("piece", piece).withColumn("r", F.row_number().over(Window.partitionBy(*keys, "size", "piece").orderBy("node")) - 1)
    rows = rows.join(before, [*keys, "size", "piece"]).join(plans, [*keys, "size"]).withColumn("r", F.col("r") + F.col("before"))
    part = F.when(F.col("r") < F.col("fits"), F.col("part")).otherwise(F.col("part") + 1 + F.floor((F.col("r") - F.col("fits")) / F.col("each")))
    return rows.withColumn("part", part.cast("long")).drop("piece", "r", "before", "fits", "each")


def blocks(members: DataFrame, weights: DataFrame, sizes: DataFrame, cannot: DataFrame, most: int | None = None, decimals: int = 6) -> DataFrame:
    """(node, block): nodes with identical rounded rows, kept apart where they must not meet and under `most` in size; a block is named by its
    smallest node. A node larger than `most` is a block of its own."""
    colored = cut(first_fit(cut(alike(members, weights, decimals), "buckets"), cannot).join(sizes, "node"), "colored")
    limit = most if most is not None else int(sizes.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0])
    parts = cut(fill_up(colored.select("node", F.col("size").cast("long").alias("size"), "bucket", "color"), ["bucket", "color"], limit), "parts")
    names = parts.groupBy("bucket", "color", "part").agg(F.min("node").alias("block"))
    return parts.join(names, ["bucket", "color", "part"]).select("node", "block")
