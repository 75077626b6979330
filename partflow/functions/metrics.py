"""Scores of partitions: modularity, reduced cost, agreement of two partitions, balance, core-periphery fit.

All come from sums over edges, communities or contingency cells; no pair matrix is formed. m is the volume, twice the total weight.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partflow.sources.graphs import both_ways, degrees, volume


def tidy(c: Column, digits: int = 9) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def community_sums(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, inside, total): weight inside counted both ways, and the members' degrees."""
    cu, cv = membership.select(F.col("node").alias("src"), F.col("community").alias("cu")), membership.select(F.col("node").alias("dst"), F.col("community").alias("cv"))
    inside = both_ways(edges).join(cu, "src").join(cv, "dst").filter("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.sum("w").alias("inside"))
    total = membership.join(degrees(edges), "node", "left").groupBy("community").agg(F.sum(F.coalesce("a", F.lit(0.0))).alias("total"))
    return total.join(inside, "community", "left").select("community", F.coalesce("inside", F.lit(0.0)).alias("inside"), "total")


def modularity_by_community(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(community, score): inside / m - gamma (total / m)^2. A graph without positive volume raises."""
    m = volume(edges)
    return community_sums(edges, membership).crossJoin(F.broadcast(m)).select(
        "community", (F.when(F.col("m") > 0, F.col("inside") / F.col("m") - gamma * (F.col("total") / F.col("m")) * (F.col("total") / F.col("m"))).otherwise(F.raise_error(F.lit("the graph has no positive edge sum"))) ).cast("double").alias("score")
    )


def modularity(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    return modularity_by_community(edges, membership, gamma).agg(F.sum("score").alias("modularity"))


def dual_weights(pairs: DataFrame, node_duals: DataFrame, pair_duals: DataFrame) -> DataFrame:
    """Weights of listed pairs (u, v): half the sum of their node duals and of the pair dual and its reverse."""
    d = node_duals.select("node", "value")
    both = pair_duals.select("u", "v", "value").unionByName(pair_duals.select(F.col("v").alias("u"), F.col("u").alias("v"), "value")).groupBy("u", "v").agg((F.sum("value") / 2).alias("p"))
    out = pairs.join(d.select(F.col("node").alias("u"), F.col("value").alias("du")), "u", "left").join(d.select(F.col("node").alias("v"), F.col("value").alias("dv")), "v", "left").join(both, ["u", "v"], "left")
    z = F.lit(0.0)
    return out.select("u", "v", ((F.coalesce("du", z) + F.coalesce("dv", z)) / 2 + F.coalesce("p", z)).alias("weight"))


def reduced_cost(edges: DataFrame, membership: DataFrame, node_duals: DataFrame, pair_duals: DataFrame, constant: float = 0.0, gamma: float = 1.0) -> DataFrame:
    """One row: modularity_term, dual_term, constant, reduced_cost. A node dual weighs its community's size; a stored pair counts once if
    its ends share a community."""
    f = modularity(edges, membership, gamma)
    size = membership.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    node = node_duals.join(membership, "node").join(size, "community").agg(F.coalesce(F.sum(F.col("value") * F.col("size")), F.lit(0.0)).alias("node_term"))
    a, b = membership.select(F.col("node").alias("u"), F.col("community").alias("cu")), membership.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    pair = pair_duals.join(a, "u").join(b, "v").filter("cu = cv").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("pair_term"))
    row = f.crossJoin(node).crossJoin(pair)
    return row.select(F.col("modularity").alias("modularity_term"), (F.col("node_term") + F.col("pair_term")).alias("dual_term"), F.lit(float(constant)).alias("constant"), (F.col("modularity") - F.col("node_term") - F.col("pair_term") - constant).alias("reduced_cost"))


def contingency(one: DataFrame, two: DataFrame) -> DataFrame:
    """(a, b, n): nodes of community a in the first partition and b in the second."""
    return one.select("node", F.col("community").alias("a")).join(two.select("node", F.col("community").alias("b")), "node").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: h_a, h_b, mutual_info (bits), nmi, vi, ari, hamming."""
    cells = contingency(one, two)
    n = F.sum("n").over(Window.partitionBy())
    na, nb = F.sum("n").over(Window.partitionBy("a")), F.sum("n").over(Window.partitionBy("b"))
    c = cells.select("a", "b", F.col("n").cast("double").alias("n"), n.cast("double").alias("t"), na.cast("double").alias("na"), nb.cast("double").alias("nb"))

    def pairs(x: Column) -> Column:
        return x * (x - 1) / 2

    s = c.agg(
        F.max("t").alias("t"), F.sum(-F.col("n") / F.col("t") * F.log2(F.col("na") / F.col("t"))).alias("h_a"), F.sum(-F.col("n") / F.col("t") * F.log2(F.col("nb") / F.col("t"))).alias("h_b"),
        F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mutual_info"), F.sum(pairs(F.col("n"))).alias("p"),
        F.sum(pairs(F.col("na")) * F.col("n") / F.col("na")).alias("pa"), F.sum(pairs(F.col("nb")) * F.col("n") / F.col("nb")).alias("pb"), F.count(F.lit(1)).alias("cells"),
        F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"),
    )
    total = pairs(F.col("t"))
    expected = F.when(total > 0, F.col("pa") * F.col("pb") / total).otherwise(F.lit(0.0))
    spread = (F.col("pa") + F.col("pb")) / 2 - expected
    same = (F.col("cells") == F.col("ka")) & (F.col("cells") == F.col("kb"))
    return s.select(
        "h_a", "h_b", "mutual_info",
        F.when(F.col("h_a") + F.col("h_b") > 0, 2 * F.col("mutual_info") / (F.col("h_a") + F.col("h_b"))).when(same, F.lit(1.0)).otherwise(F.lit(0.0)).alias("nmi"),
        (F.col("h_a") + F.col("h_b") - 2 * F.col("mutual_info")).alias("vi"),
        F.when((total == 0) | (F.abs(spread) < 1e-12), F.lit(1.0)).otherwise((F.col("p") - expected) / F.when(F.abs(spread) < 1e-12, F.lit(1.0)).otherwise(spread)).alias("ari"),
        F.when(total > 0, (F.col("pa") + F.col("pb") - 2 * F.col("p")) / total).otherwise(F.lit(0.0)).alias("hamming"),
    )


def best_matching(gain: np.ndarray) -> tuple[float, dict[int, int]]:
    """Maximum-weight matching of rows to columns: shortest augmenting paths with potentials."""
    r, c = gain.shape
    n = max(r, c)
    cost = np.zeros((n, n))
    cost[:r, :c] = gain.max(initial=0) - gain
    row_potential, column_potential = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for i in range(n):
        reach, via, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        at, column, base = i, -1, 0.0
        while True:
            slack = base + cost[at] - row_potential[at] - column_potential
            better = ~done & (slack < reach - 1e-12)
            reach[better], via[better] = slack[better], column
            column = int(np.argmin(np.where(done, np.inf, reach)))
            base, done[column] = reach[column], True
            if row_of[column] < 0:
                break
            at = int(row_of[column])
        row_potential[i] += base
        for j in np.flatnonzero(done):
            if j != column:
                row_potential[row_of[j]] += base - reach[j]
                column_potential[j] -= base - reach[j]
        while column >= 0:
            before = int(via[column])
            row_of[column] = row_of[before] if before >= 0 else i
            column = before
    pairs = {int(row_of[j]): j for j in range(n) if row_of[j] < r and j < c}
    return float(sum(gain[i, j] for i, j in pairs.items())), pairs


def permuted_accuracy(truth: DataFrame, found: DataFrame) -> tuple[float, dict[int, int]]:
    """(share of nodes that agree under the best relabelling, found label -> true label). The k x k table comes to the driver."""
    rows = contingency(truth, found).collect()
    if not rows:
        return 0.0, {}
    a, b = sorted({r["a"] for r in rows}), sorted({r["b"] for r in rows})
    table = np.zeros((len(b), len(a)))
    for r in rows:
        table[b.index(r["b"]), a.index(r["a"])] = r["n"]
    value, pairs = best_matching(table)
    return float(value / table.sum()), {b[i]: a[j] for i, j in pairs.items()}


def optimality_gap(edges: DataFrame, truth: DataFrame, found: DataFrame, tol: float = 1e-12) -> DataFrame:
    t, f = modularity(edges, truth).select(F.col("modularity").alias("t")), modularity(edges, found).select(F.col("modularity").alias("f"))
    return t.crossJoin(f).select(((F.col("t") - F.col("f")) * 100 / (F.col("f") + tol)).alias("gap"))


def pool_distance(found: DataFrame, pool: DataFrame) -> DataFrame:
    """(part_id, hamming) of a partition to each of a pool (part_id, node, community)."""
    cells = pool.join(found.select("node", F.col("community").alias("b")), "node").groupBy("part_id", F.col("community").alias("a"), "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    def half(n: Column) -> Column:
        return n * (n - 1) / 2
    joint = cells.groupBy("part_id").agg(F.sum(half(F.col("n"))).alias("p"), F.sum("n").alias("t"))
    side = [cells.groupBy("part_id", k).agg(F.sum("n").alias("n")).groupBy("part_id").agg(F.sum(half(F.col("n"))).alias(f"p{k}")) for k in ("a", "b")]
    return joint.join(side[0], "part_id").join(side[1], "part_id").select("part_id", F.when(F.col("t") > 1, (F.col("pa") + F.col("pb") - 2 * F.col("p")) / half(F.col("t"))).otherwise(F.lit(0.0)).alias("hamming"))


def sufficiently_different(found: DataFrame, pool: DataFrame, least: float) -> DataFrame:
    """One row `different`: the nearest of the pool is at `least` or more; an empty pool differs."""
    return pool_distance(found, pool).agg(F.coalesce(F.min("hamming") >= least, F.lit(True)).alias("different"))


def balance_bounds(n: int, k: int | None = None, r: int | None = None, bounds: tuple[int | None, int | None] | None = None) -> tuple[int, int]:
    """Least and largest community size: from (low, high) if given, else from k communities that differ by r at most."""
    if bounds is not None:
        low, high = bounds
        low, high = 1 if low is None else int(low), n if high is None else min(int(high), n)
    elif k is None or r is None:
        raise ValueError("give bounds, or k and r")
    else:
        low = max(1, math.floor(n / k - r / 2 + 0.5))
        high = low + int(r)
    if low < 1 or high < low:
        raise ValueError(f"no community size lies within {low}..{high}")
    return low, high


def feasible_counts(n: int, low: int, high: int) -> range:
    """Numbers of communities of low..high nodes that n nodes can make."""
    return range(max(1, -(-n // high)), n // low + 1)


def target_sizes(n: int, k: int) -> list[int]:
    return [n // k + (i < n % k) for i in range(k)]


def upper_slack(n: int, k: int, high: int) -> float:
    """How far the largest community may exceed the mean, as a share."""
    return max(0.0, high / (n / k) - 1)


def check_balance(membership: DataFrame, low: int, high: int) -> DataFrame:
    size = membership.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    return size.agg(F.min("n").alias("smallest"), F.max("n").alias("largest")).select("smallest", "largest", ((F.col("smallest") >= low) & (F.col("largest") <= high)).alias("balanced"))


def block_sums(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a, b, weight): adjacency summed over every ordered pair of blocks that has edges."""
    x, y = blocks.select(F.col("node").alias("src"), F.col("block").alias("a")), blocks.select(F.col("node").alias("dst"), F.col("block").alias("b"))
    return both_ways(edges).join(x, "src").join(y, "dst").groupBy("a", "b").agg(F.sum("w").alias("weight"))


def block_excess(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a, b, excess): block sums of A - a a' / m, for every pair of blocks."""
    total = blocks.join(degrees(edges), "node", "left").groupBy("block").agg(F.sum(F.coalesce("a", F.lit(0.0))).alias("t"))
    pairs = total.select(F.col("block").alias("a"), F.col("t").alias("ta")).crossJoin(total.select(F.col("block").alias("b"), F.col("t").alias("tb"))).crossJoin(F.broadcast(volume(edges)))
    return pairs.join(block_sums(edges, blocks), ["a", "b"], "left").select("a", "b", (F.coalesce("weight", F.lit(0.0)) - F.col("ta") * F.col("tb") / F.col("m")).alias("excess"))


def block_means(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a, b, mean): mean adjacency between blocks that have edges, 1 on the diagonal."""
    n = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    rows = block_sums(edges, blocks).filter("a <> b").join(n.select(F.col("block").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("block").alias("b"), F.col("n").alias("nb")), "b")
    return rows.select("a", "b", (F.col("weight") / (F.col("na") * F.col("nb"))).alias("mean")).unionByName(n.select(F.col("block").alias("a"), F.col("block").alias("b"), F.lit(1.0).alias("mean")))


def node_community_scores(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(node, community, score): what the node's row of A/m - gamma a a'/m^2 sums to over each community that it touches or is in."""
    c = membership.select(F.col("node").alias("dst"), "community")
    into = both_ways(edges).join(c, "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("k"))
    own = membership.select("node", "community", F.lit(0.0).alias("k"))
    rows = into.unionByName(own).groupBy("node", "community").agg(F.sum("k").alias("k"))
    total = community_sums(edges, membership).select("community", "total")
    return rows.join(total, "community").join(degrees(edges), "node").crossJoin(F.broadcast(volume(edges))).select("node", "community", (F.col("k") / F.col("m") - gamma * F.col("a") * F.col("total") / (F.col("m") * F.col("m"))).alias("score"))


def move_gains(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(node, to, gain) of moving a node to another community that it touches."""
    s = node_community_scores(edges, membership, gamma)
    loops = both_ways(edges).filter("src = dst").select(F.col("src").alias("node"), F.col("w").alias("loop"))
    own = s.join(membership.select("node", "community"), ["node", "community"]).join(loops, "node", "left").join(degrees(edges), "node").crossJoin(F.broadcast(volume(edges)))
    own = own.select("node", F.col("community").alias("home"), (F.col("score") - (F.coalesce("loop", F.lit(0.0)) / F.col("m") - gamma * F.col("a") * F.col("a") / (F.col("m") * F.col("m")))).alias("stay"))
    return s.join(own, "node").filter("community <> home").select("node", F.col("community").alias("to"), (2 * (F.col("score") - F.col("stay"))).alias("gain"))


def swap_gains(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(u, v, gain) of exchanging the ends of every edge between two communities."""
    member, k = membership.select("node", "community"), degrees(edges)
    touch = both_ways(edges).join(member.withColumnRenamed("node", "dst"), "dst").groupBy("src", "community").agg(F.sum("w").alias("t"))
    total = member.join(k, "node", "left").groupBy("community").agg(F.sum(F.coalesce("a", F.lit(0.0))).alias("t"))
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.col("w").alias("loop"))
    pairs = edges.filter("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), "w")
    for end in "uv":
        for table, old, new in ((member, "community", f"c{end}"), (k, "a", f"a{end}"), (loops, "loop", f"l{end}")):
            pairs = pairs.join(table.select(F.col("node").alias(end), F.col(old).alias(new)), end, "left" if old == "loop" else "inner")
        pairs = pairs.join(total.select(F.col("community").alias(f"c{end}"), F.col("t").alias(f"t{end}")), f"c{end}")
    pairs = pairs.filter("cu <> cv")
    for end, of in ("uu", "uv", "vu", "vv"):
        pairs = pairs.join(touch.select(F.col("src").alias(end), F.col("community").alias(f"c{of}"), F.col("t").alias(f"s{end}{of}")), [end, f"c{of}"], "left")
    pairs = pairs.crossJoin(F.broadcast(volume(edges)))

    def worth(weight, x, y):  # weight / m - gamma x y / m^2
        return F.coalesce(weight, F.lit(0.0)) / F.col("m") - gamma * F.col(x) * F.col(y) / (F.col("m") * F.col("m"))

    moved = worth(F.col("suv"), "au", "tv") + worth(F.col("svu"), "av", "tu") - worth(F.col("suu"), "au", "tu") - worth(F.col("svv"), "av", "tv")
    return pairs.select("u", "v", (2 * moved + 2 * worth(F.col("lu"), "au", "au") + 2 * worth(F.col("lv"), "av", "av") - 4 * worth(F.col("w"), "au", "av")).alias("gain"))


def merge_gains(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(a, b, gain) of merging two communities (a < b)."""
    blocks = membership.select("node", F.col("community").alias("block"))
    return block_excess_gamma(edges, blocks, gamma).filter("a < b").select("a", "b", (2 * F.col("excess")).alias("gain"))


def block_excess_gamma(edges: DataFrame, blocks: DataFrame, gamma: float) -> DataFrame:
    total = blocks.join(degrees(edges), "node", "left").groupBy("block").agg(F.sum(F.coalesce("a", F.lit(0.0))).alias("t"))
    pairs = total.select(F.col("block").alias("a"), F.col("t").alias("ta")).crossJoin(total.select(F.col("block").alias("b"), F.col("t").alias("tb"))).crossJoin(F.broadcast(volume(edges)))
    return pairs.join(block_sums(edges, blocks), ["a", "b"], "left").select("a", "b", (F.coalesce("weight", F.lit(0.0)) / F.col("m") - gamma * F.col("ta") * F.col("tb") / (F.col("m") * F.col("m"))).alias("excess"))


def signed_modularity(layers: DataFrame, membership: DataFrame, weights: dict[int, float], resolution: float = 1.0) -> DataFrame:
    """Sum over layers of weight (inside / m - resolution sum (total / m)^2)."""
    out = None
    for layer, weight in weights.items():
        e = layers.filter(F.col("layer") == layer).select("src", "dst", "w")
        sums = community_sums(e, membership).crossJoin(F.broadcast(volume(e))).agg(F.coalesce(F.sum(F.when(F.col("m") > 0, F.col("inside") / F.col("m") - resolution * (F.col("total") / F.col("m")) * (F.col("total") / F.col("m")))), F.lit(0.0)).alias("q"))
        part = sums.select((F.col("q") * weight).alias("q"))
        out = part if out is None else out.unionByName(part)
    return out.agg(F.sum("q").alias("signed_modularity"))


def signed_move_gains(layers: DataFrame, membership: DataFrame, weights: dict[int, float], resolution: float = 1.0) -> DataFrame:
    """(node, to, gain) of moving a node to another community that it touches in any layer: what inserting it there is worth less what it
    is worth at home, each layer by its weight."""
    sign = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    back = layers.select("layer", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    s = layers.filter("src <> dst").select("layer", "src", "dst", "w").unionByName(back.filter("src <> dst"))
    k = s.groupBy("layer", F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    twice = k.groupBy("layer").agg(F.sum("k").alias("l2"))
    total = k.join(membership, "node").groupBy("layer", "community").agg(F.sum("k").alias("deg"))
    into = s.join(membership.select(F.col("node").alias("dst"), "community"), "dst").groupBy("layer", F.col("src").alias("node"), "community").agg(F.sum("w").alias("kic"))
    touched = into.select("node", "community").distinct().unionByName(membership.select("node", "community")).distinct()
    rows = touched.join(k, "node").join(twice, "layer").join(total, ["layer", "community"], "left").join(into, ["layer", "node", "community"], "left")
    rows = rows.join(membership.select("node", F.col("community").alias("home")), "node")
    deg = F.coalesce("deg", F.lit(0.0)) - F.when(F.col("community") == F.col("home"), F.col("k")).otherwise(F.lit(0.0))
    worth = sign[F.col("layer")] * (F.coalesce("kic", F.lit(0.0)) - resolution * deg * F.col("k") / F.col("l2"))
    value = rows.groupBy("node", "home", "community").agg(F.sum(worth).alias("worth"))
    stay = value.filter("community = home").select("node", F.col("worth").alias("stay"))
    return value.filter("community <> home").join(stay, "node").select("node", F.col("community").alias("to"), (F.col("worth") - F.col("stay")).alias("gain"))


def be_score(edges: DataFrame, coreness: DataFrame, binary: bool = True) -> DataFrame:
    """One row `score`: Pearson correlation over node pairs of A_ij with max(c_i, c_j) (binary) or c_i c_j, from sums alone; 0 if either is constant."""
    e = edges.filter("src <> dst")
    c = coreness.select("node", F.col("c").cast("double").alias("c"))
    x, y = c.select(F.col("node").alias("src"), F.col("c").alias("cu")), c.select(F.col("node").alias("dst"), F.col("c").alias("cv"))
    d = F.greatest("cu", "cv") if binary else F.col("cu") * F.col("cv")
    on = e.join(x, "src").join(y, "dst").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("sa"), F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0)).alias("saa"), F.coalesce(F.sum(F.col("w") * d), F.lit(0.0)).alias("sad"))
    s = c.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("c").alias("s1"), F.sum(F.col("c") * F.col("c")).alias("s2"), F.sum(F.pow("c", F.lit(4.0))).alias("s4")).crossJoin(on)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    if binary:  # pairs with at least one core node
        rest = F.col("n") - F.col("s1")
        sd = pairs - rest * (rest - 1) / 2
        sdd = sd
    else:
        sd = (F.col("s1") * F.col("s1") - F.col("s2")) / 2
        sdd = (F.col("s2") * F.col("s2") - F.col("s4")) / 2
    cov = F.col("sad") - F.col("sa") * sd / pairs
    va, vd = F.col("saa") - F.col("sa") * F.col("sa") / pairs, sdd - sd * sd / pairs
    return s.select(F.when((va > 1e-12) & (vd > 1e-12), cov / F.sqrt(F.when((va > 1e-12) & (vd > 1e-12), va * vd).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0)).alias("score"))
