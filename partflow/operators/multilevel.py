"""Balanced k-way partitions of high modularity by a multilevel scheme, in joins and aggregations.

1. Coarsen: rounds of heavy-edge matching (an edge is taken if it is the heaviest, by seeded priority, at both its ends, and the pair stays
   well under a part's size), matched nodes become one, parallel edges are summed; until few nodes are left or matching stalls.
2. Cut the coarsest graph's line of nodes into k parts of even weight.
3. Uncoarsen level by level; at each, rounds of moves that raise the score and keep sizes in bounds. Nodes that go the same way between two
   parts move together, and no two such groups touch one part.
4. At the finest level parts that are too large give nodes to parts that are too small, those least attached first, as many as bounds ask
   for; then rounds of moves and of swaps between disjoint pairs of parts, and where no swap helps of compound moves over disjoint triples
   of parts, each of which raises the score by exactly its gain.

Sizes are numbers of nodes. k is a parameter of tens to thousands: tables of one row a part, or a pair of linked parts, are small; the coarsest
graph has COARSEST * k nodes or stalls, and its line is the only window over nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partflow.functions.storage import cut, release, sent

from .louvain import EPS, apart, between, gains, start

COARSEST = 20


def matching(state: DataFrame, arcs: DataFrame, most: int, seed: int) -> DataFrame:
    """(u, v), u < v: edges that are the heaviest at both ends among those whose ends hold at most `most` nodes together."""
    size, nodes = state.select("node", "size"), state.count()
    x, y = (sent(size.select(F.col("node").alias(end), F.col("size").alias(name)), nodes) for end, name in (("src", "x"), ("dst", "y")))
    e = arcs.join(x, "src").join(y, "dst")
    u, v = F.least("src", "dst"), F.greatest("src", "dst")
    key = F.struct(F.round("e", 12).alias("e"), F.xxhash64(u, v, F.lit(seed)).alias("p"), u.alias("src"), v.alias("dst"))
    best = e.filter((F.col("x") + F.col("y") <= most) & (F.col("e") > 0)).groupBy("src").agg(F.max(key).alias("key"))
    return best.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k = 2").select(F.col("key.src").alias("u"), F.col("key.dst").alias("v"))


def weights(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """The arcs of stored pairs (src, dst): where pairs are few, Spark sends them to the arcs instead of shuffling those."""
    return arcs.join(pairs.distinct(), ["src", "dst"], "left_semi")


def coarsen(state: DataFrame, arcs: DataFrame, k: int, most: int, seed: int = 0) -> list[tuple[DataFrame, DataFrame, DataFrame | None]]:
    """Levels (state, arcs, which node of the next level each is in), the finest first; the last has no next."""
    levels, n = [], state.count()
    while n > COARSEST * k:
        pairs = matching(state, arcs, most, seed + len(levels))
        of = cut(state.select("node").join(pairs.select(F.col("v").alias("node"), F.col("u").alias("to")), "node", "left").select("node", F.coalesce("to", "node").alias("up")), "of")
        up = cut(state.join(of, "node").groupBy(F.col("up").alias("node")).agg(F.sum("a").alias("a"), F.sum("size").alias("size"), F.sum("dual").alias("dual")).withColumn("community", F.col("node")), "level")
        fewer = between(arcs, of.select("node", F.col("up").alias("community")))
        levels.append((state, arcs, of))
        left = up.count()
        state, arcs, n, stalled = up, fewer, left, left > 0.9 * n
        if stalled:
            break
    return [*levels, (state, arcs, None)]


def bounded_round(state: DataFrame, arcs: DataFrame, low: int, high: int, seed: int, gamma: float = 1.0) -> DataFrame:
    """The state after a round of moves that raise the score and keep both parts within low..high.

    Nodes that go the same way between two parts go together, best first, while sizes allow and each gains more than those before it can take
    away: two nodes that leave and arrive together lose 4 gamma a a' at most against moving alone (edges between them add to that, as
    weights aren't negative). Of all such groups those go ahead that are the best at both their parts."""
    rows = gains(state, arcs, gamma).filter((F.col("n2") + F.col("size") <= high) & (F.col("n") - F.col("size") >= low) & (F.col("gain") > EPS))
    best = rows.groupBy("node", "community").agg(F.max(F.struct("gain", (-F.col("to")).alias("last"), "a", "size", "n", "n2")).alias("m"))
    best = best.select("node", "community", (-F.col("m.last")).alias("to"), "m.gain", "m.a", "m.size", "m.n", "m.n2")
    line = Window.partitionBy("community", "to").orderBy(F.desc("gain"), "node")
    before = F.coalesce(F.sum("a").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    upto = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))
    best = best.withColumn("sure", F.round(F.col("gain") - 4 * gamma * F.col("a") * before, 12)).withColumn("fits", (F.col("n2") + upto <= high) & (F.col("n") - upto >= low))
    best = best.withColumn("goes", F.bool_and(F.col("fits") & (F.col("sure") > EPS)).over(line.rowsBetween(Window.unboundedPreceding, 0))).filter("goes")
    moves = cut(best.select("node", "community", "to", "sure"), "moves")
    groups = moves.groupBy("community", "to").agg(F.min("node").alias("node"), F.round(F.sum("sure"), 12).alias("gain"))
    won = apart(groups.select("node", "community", "to", "gain"), seed).select("community", "to")
    return _moved(state, moves.join(won, ["community", "to"]).select("node", "to"))


def _moved(state: DataFrame, moves: DataFrame) -> DataFrame:
    out = state.drop("moved").join(moves.select(F.col("node").alias("_n"), "to"), F.col("node") == F.col("_n"), "left")
    return cut(out.select("node", "a", "size", "dual", F.coalesce("to", "community").alias("community"), F.col("to").isNotNull().alias("moved")), "level")


def settle(state: DataFrame, arcs: DataFrame, parts: DataFrame, low: int, high: int) -> DataFrame:
    """The state with every part (parts: community) within low..high; nodes count one each. Parts give and take by running sums over parts."""
    n = parts.join(state.groupBy("community").agg(F.sum("size").alias("n")), "community", "left").select("community", F.coalesce("n", F.lit(0)).alias("n"))
    over, under = F.greatest(F.col("n") - high, F.lit(0)), F.greatest(low - F.col("n"), F.lit(0))
    could_give, could_take = F.greatest(F.least("n", F.lit(high)) - low, F.lit(0)), F.greatest(high - F.greatest("n", F.lit(low)), F.lit(0))
    rows = cut(n.select("community", over.alias("over"), under.alias("under"), could_give.alias("give"), could_take.alias("take")), "parts")
    flow = rows.agg(F.greatest(F.sum("over"), F.sum("under"))).first()[0] or 0
    if not flow:
        return state
    sides = []
    for must, may in (("over", "give"), ("under", "take")):
        line = rows.select("community", F.lit(0).alias("late"), F.col(must).alias("q")).unionByName(rows.select("community", F.lit(1).alias("late"), F.col(may).alias("q"))).filter("q > 0")
        w = Window.orderBy("late", "community")
        line = line.withColumn("end", F.least(F.sum("q").over(w), F.lit(flow))).withColumn("start", F.coalesce(F.lag("end").over(w), F.lit(0))).filter("start < end")
        sides.append(line.select("community", "start", "end"))
    given, taken = sides
    # one slot a node that changes parts; a part's slots go to its nodes in order of attachment
    slots = given.select("community", F.explode(F.sequence("start", F.col("end") - 1)).alias("slot"))
    to = taken.select(F.col("community").alias("to"), F.explode(F.sequence("start", F.col("end") - 1)).alias("slot"))
    slots = slots.join(to, "slot").withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("slot"))).select("community", "to", "r")
    nodes = state.count()
    x, y = (sent(state.select(F.col("node").alias(end), F.col("community").alias(name)), nodes) for end, name in (("src", "x"), ("dst", "y")))
    own = arcs.join(x, "src").join(y, "dst").filter("x = y").groupBy(F.col("src").alias("node")).agg(F.round(F.sum("e"), 12).alias("own"))
    givers = state.join(given.select("community").distinct(), "community").join(own, "node", "left")
    ranked = givers.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.coalesce("own", F.lit(0.0)), "node")))
    return _moved(state, ranked.join(slots, ["community", "r"]).select("node", "to"))


def swap_round(state: DataFrame, arcs: DataFrame, seed: int, gamma: float = 1.0) -> DataFrame:
    """The state after swaps of nodes of one size between disjoint pairs of parts: of each pair of parts the best movers either way, if both
    moves together raise the score."""
    rows = gains(state, arcs, gamma).groupBy("community", "to", "size").agg(F.max(F.struct("gain", (-F.col("node")).alias("last"), "a")).alias("m"))
    rows = cut(rows.select("community", "to", "size", (-F.col("m.last")).alias("node"), "m.gain", "m.a"), "movers")
    one, two = rows.filter("community < to"), rows.filter("community > to").select(F.col("to").alias("community"), F.col("community").alias("to"), "size", F.col("node").alias("node2"), F.col("gain").alias("gain2"), F.col("a").alias("a2"))
    both = cut(one.join(two, ["community", "to", "size"]), "pairs")
    met = weights(both.select(F.col("node").alias("src"), F.col("node2").alias("dst")), arcs).select(F.col("src").alias("node"), F.col("dst").alias("node2"), "e")
    both = both.join(met, ["node", "node2"], "left")
    total = F.col("gain") + F.col("gain2") - 4 * F.coalesce("e", F.lit(0.0)) + 4 * gamma * F.col("a") * F.col("a2")
    both = both.select("node", "node2", "community", "to", F.round(total, 12).alias("gain")).filter(F.col("gain") > EPS)
    best = cut(both.groupBy("community", "to").agg(F.max(F.struct("gain", "node", "node2")).alias("m")).select("community", "to", "m.node", "m.node2", "m.gain"), "swaps")
    won = best.join(apart(best.select("node", "community", "to", "gain"), seed).select("node", "community", "to"), ["node", "community", "to"])
    return _moved(state, won.select("node", "to").unionByName(won.select(F.col("node2").alias("node"), F.col("community").alias("to"))))


def chains(state: DataFrame, arcs: DataFrame, low: int, high: int, gamma: float = 1.0) -> DataFrame:
    """(c1, c2, c3, n1, n2, n3, closed, gain): compound moves over three parts, n1 from c1 to c2 and n2 from c2 to c3; closed ones send n3 from c3 to c1
    and keep all sizes (n1, n2 and n3 are of one size), open ones have no n3 and leave c1 and c3 within low..high. The movers are
    the best from part to part, so there are at most as many rows as paths of linked parts; the gain is exact."""
    best = gains(state, arcs, gamma).groupBy("community", "to", "size").agg(F.max(F.struct("gain", (-F.col("node")).alias("last"), "a", "n", "n2")).alias("m"))
    best = cut(best.select("community", "to", "size", (-F.col("m.last")).alias("node"), "m.gain", "m.a", "m.n", "m.n2"), "movers")

    def mover(k: int, at: str, to: str) -> DataFrame:
        return best.select(F.col("community").alias(at), F.col("to").alias(to), "size", F.col("node").alias(f"n{k}"), F.col("gain").alias(f"g{k}"), F.col("a").alias(f"a{k}"), F.col("n").alias(f"s{k}"), F.col("n2").alias(f"t{k}"))

    def tie(rows: DataFrame, p: int, q: int) -> DataFrame:
        rows = cut(rows, "paths")
        e = weights(rows.select(F.col(f"n{p}").alias("src"), F.col(f"n{q}").alias("dst")), arcs).select(F.col("src").alias(f"n{p}"), F.col("dst").alias(f"n{q}"), F.col("e").alias("_e"))
        shared = 2 * (F.coalesce("_e", F.lit(0.0)) - gamma * F.col(f"a{p}") * F.col(f"a{q}"))
        return rows.join(e, [f"n{p}", f"n{q}"], "left").withColumn("gain", F.col("gain") - shared).drop("_e")

    path = mover(1, "c1", "c2").join(mover(2, "c2", "c3"), ["c2", "size"]).filter("c1 <> c3").withColumn("gain", F.col("g1") + F.col("g2"))
    path = cut(tie(path, 1, 2), "paths")
    open_ = path.filter((F.col("s1") - F.col("size") >= low) & (F.col("t2") + F.col("size") <= high))
    open_ = open_.select("c1", "c2", "c3", "n1", "n2", F.lit(None).cast("long").alias("n3"), F.lit(False).alias("closed"), "gain")
    ring = path.filter("c1 < c2 and c1 < c3").join(mover(3, "c3", "c1"), ["c3", "c1", "size"]).withColumn("gain", F.col("gain") + F.col("g3"))
    ring = tie(tie(ring, 2, 3), 1, 3).select("c1", "c2", "c3", "n1", "n2", "n3", F.lit(True).alias("closed"), "gain")
    return ring.unionByName(open_).withColumn("gain", F.round("gain", 12))


def chain_round(state: DataFrame, arcs: DataFrame, low: int, high: int, gamma: float = 1.0) -> DataFrame:
    """The state after compound moves that raise the score, of which no two touch one part."""
    rows = cut(chains(state, arcs, low, high, gamma).filter(F.col("gain") > EPS), "chains")
    key = F.struct("gain", "c1", "c2", "c3", "closed", "n1", "n2")
    best = rows.select(F.explode(F.array("c1", "c2", "c3")).alias("at"), key.alias("key")).groupBy("at").agg(F.max("key").alias("key"))
    won = best.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k = 3").select("key.*").drop("gain")
    won = rows.join(won, ["c1", "c2", "c3", "closed", "n1", "n2"], "left_semi")
    steps = F.array(F.struct(F.col("n1").alias("node"), F.col("c2").alias("to")), F.struct(F.col("n2").alias("node"), F.col("c3").alias("to")), F.struct(F.col("n3").alias("node"), F.col("c1").alias("to")))
    return _moved(state, won.select(F.explode(steps).alias("s")).select("s.node", "s.to").filter("node is not null"))


def balanced_kway(edges: DataFrame, nodes: DataFrame, k: int, low: int, high: int, gamma: float = 1.0, rounds: int = 6, swaps: int = 5, seed: int = 0) -> DataFrame:
    """(node, community): k communities of low..high nodes each, numbered from 0. Raises if k such communities can't hold the nodes."""
    state, arcs = start(edges, nodes)
    n = state.count()
    if not k * low <= n <= k * high:
        raise ValueError(f"{k} communities of {low} to {high} nodes can't hold {n}")
    levels = coarsen(state, arcs, k, max(1, high // 4), seed)
    top = levels[-1][0]
    upto = F.sum("size").over(Window.orderBy("node"))
    line = top.withColumn("community", F.least(F.floor((upto - F.col("size") / 2) * k / n), F.lit(k - 1)).cast("long"))
    labels = cut(line.select("node", "community"), "labels")
    parts = edges.sparkSession.range(k).select(F.col("id").alias("community"))
    for depth in range(len(levels) - 1, -1, -1):
        state, arcs, of = levels[depth]
        if of is not None:
            labels = of.join(labels.select(F.col("node").alias("up"), "community"), "up").select("node", "community")
        state = cut(state.drop("community").join(labels, "node"), "level")
        if depth == 0:
            state = settle(state, arcs, parts, low, high)
        for turn in range(rounds):
            old, state = state, bounded_round(state, arcs, low, high, seed + turn, gamma)
            release(old)
            if state.filter("moved").isEmpty():
                break
        labels = cut(state.select("node", "community"), "labels")
    for turn in range(swaps):
        old, state = state, swap_round(state, arcs, seed + turn, gamma)
        release(old)
        if state.filter("moved").isEmpty():
            old, state = state, chain_round(state, arcs, low, high, gamma)
            release(old)
            if state.filter("moved").isEmpty():
                break
    return state.select("node", "community")
