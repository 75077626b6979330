"""Beams, orbits, density labels and compound moves: small inputs by hand, and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partflow.operators import beam as be
from partflow.operators import density as de
from partflow.operators import multilevel as ml
from partflow.operators import symmetry as sy
from tests.test_plans import graph, nodes

# ------------------------------------------------------------------ beams


def columns(spark, blocks, order, conflicts, k, low, high, **how):
    b = spark.createDataFrame(list(enumerate(blocks)), "node bigint, block bigint")
    o = spark.createDataFrame([(r, 0, x, p) for r, line in enumerate(order) for p, x in enumerate(line)], "run int, seed bigint, node bigint, pos bigint")
    c = spark.createDataFrame(conflicts, "u bigint, v bigint")
    return [(r["run"], r["node"], r["block"], r["community"]) for r in be.columns(o, b, c, k, low, high, **how).collect()]


def test_beam_keeps_sizes_and_links(spark):
    blocks = [0, 0, 1, 2, 3, 3, 4, 5]
    found = columns(spark, blocks, [[0, 1, 2, 3, 4, 5]], [(0, 1), (2, 3), (4, 5)], 2, 4, 4)
    at = {n: c for _, n, _, c in found}
    assert len(at) == 8 and sorted(list(at.values()).count(c) for c in (0, 1)) == [4, 4]
    assert all(at[n] == at[m] for n, m in itertools.combinations(range(8), 2) if blocks[n] == blocks[m])
    of = {b: c for _, _, b, c in found}
    assert of[0] != of[1] and of[2] != of[3] and of[4] != of[5]


def test_beam_is_exhaustive_when_wide(spark):
    """A wide beam finds an assignment exactly where there is one."""
    rng = random.Random(5)
    for _ in range(3):
        size = [rng.randint(1, 3) for _ in range(5)]
        blocks = [b for b, n in enumerate(size) for _ in range(n)]
        apart = [p for p in itertools.combinations(range(5), 2) if rng.random() < 0.4]
        n = len(blocks)
        low, high = n // 3, -(-n // 3) + 1
        some = any(all(x[u] != x[v] for u, v in apart) and all(low <= sum(s for b, s in enumerate(size) if x[b] == c) <= high for c in range(3)) for x in itertools.product(range(3), repeat=5))
        found = columns(spark, blocks, [list(range(5))], apart, 3, low, high, width=300, branch=3, tries=1)
        assert bool(found) == some


def test_beam_gives_each_partition_once_and_drops_dead_runs(spark):
    assert {r for r, *_ in columns(spark, [0, 1, 2, 3], [[0, 1, 2, 3], [0, 1, 2, 3]], [], 2, 2, 2)} == {0}
    assert columns(spark, [0, 1, 2], [[0, 1, 2]], [(0, 1), (1, 2), (0, 2)], 2, 1, 2, tries=2) == []
    assert columns(spark, [], [], [], 2, 0, 2) == []
    with pytest.raises(ValueError):
        columns(spark, [0, 0], [[0]], [(0, 0)], 2, 0, 2)


# ------------------------------------------------------------------ orbits


def brute_orbits(n, edges, colors=None):
    a = np.zeros((n, n))
    for u, v, w in edges:
        a[u, v] += w
        a[v, u] = a[u, v]
    rep = list(range(n))
    for p in itertools.permutations(range(n)):
        if (colors is None or all(colors[i] == colors[p[i]] for i in range(n))) and (a[np.ix_(p, p)] == a).all():
            for i in range(n):
                rep[i] = min(rep[i], p[i])
    return dict(enumerate(rep))


@pytest.mark.parametrize("name", ["cycle", "two triangles beside a hexagon's half", "weighted path", "random"])
def test_orbits_match_all_permutations(spark, name):
    cases = {
        "cycle": (6, [(i, (i + 1) % 6, 1.0) for i in range(6)], None),
        "two triangles beside a hexagon's half": (7, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0)], [0, 0, 0, 0, 0, 1, 0]),
        "weighted path": (4, [(0, 1, 2.0), (1, 2, 1.0), (2, 3, 2.0 + 1e-12)], None),
        "random": (7, [(u, v, 1.0) for u, v in itertools.combinations(range(7), 2) if random.Random(u * 7 + v).random() < 0.4], None),
    }
    n, edges, colors = cases[name]
    c = spark.createDataFrame(list(enumerate(map(str, colors))), "node bigint, color string") if colors else None
    found, _ = sy.orbits(graph(spark, edges), nodes(spark, n), c)
    want = brute_orbits(n, [(u, v, round(w, 9)) for u, v, w in edges], colors)
    assert {r["node"]: r["orbit"] for r in found.collect()} == want


def test_regular_graphs_that_refinement_cannot_tell_apart(spark):
    """A triangle pair and a hexagon have one refined color, but two orbits."""
    edges = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0)] + [(6 + i, 6 + (i + 1) % 6, 1.0) for i in range(6)]
    found, _ = sy.orbits(graph(spark, edges), nodes(spark, 12))
    assert {r["node"]: r["orbit"] for r in found.collect()} == {i: 0 if i < 6 else 6 for i in range(12)}


def test_orbits_of_nothing(spark):
    assert sy.orbits(graph(spark, []), nodes(spark, 0))[0].collect() == []


# ------------------------------------------------------------------ density


def test_near_pairs_match_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((40, 3)) * (rng.random((40, 3)) < 0.7), 3)
    x[20:25] = x[3]
    shares = spark.createDataFrame([(i, c, float(x[i, c])) for i in range(40) for c in range(3)], "node bigint, community bigint, share double")
    at, of = de.points(shares)
    point = {r["node"]: r["point"] for r in of.collect()}
    assert all(point[i] == 3 for i in range(20, 25))
    near = {(r["u"], r["v"]) for r in de.near_pairs(at, 0.3).collect()}
    names = sorted(set(point.values()))
    assert near == {(i, j) for i in names for j in names if ((x[i] - x[j]) ** 2).sum() <= 0.09 + 1e-12}


def test_density_labels_scale_and_drop_the_rarest(spark):
    rows = [(i, 0, 0.8 + i / 1000) for i in range(6)] + [(i, 1, 0.9 + i / 1000) for i in range(6, 12)] + [(12, 0, 0.4), (12, 1, 0.6)]
    shares = spark.createDataFrame(rows, "node bigint, community bigint, share double")
    got = {r["node"]: r["label"] for r in de.label_by_density(shares, 0.1, 3).collect()}
    assert got == {**{i: 0 for i in range(6)}, **{i: 1 for i in range(6, 12)}, 12: -1}
    assert de.label_by_density(shares.limit(0)).collect() == []


def test_equal_shares_have_no_spread(spark):
    shares = spark.createDataFrame([(i, 0, 1.0) for i in range(5)] + [(5, 0, None)], "node bigint, community bigint, share double")
    got = {r["node"]: r["label"] for r in de.label_by_cluster(shares, 0.1, 2).collect()}
    assert got == {**{i: 0 for i in range(5)}, 5: -1}


# ------------------------------------------------------------------ compound moves


def _value(a, labels):
    m = a.sum()
    d = a.sum(1) / m
    return float(((a / m - np.outer(d, d)) * (labels[:, None] == labels[None, :])).sum())


def _stalled():
    """A graph of nine nodes in three parts that neither a move within 3..3 nor a swap helps, but passing three nodes round does."""
    for seed in range(2000):
        rng = np.random.default_rng(seed)
        a = np.triu(rng.integers(0, 6, (9, 9)) * (rng.random((9, 9)) < 0.5), 1).astype(float)
        a = a + a.T
        labels = np.arange(9) % 3
        now = _value(a, labels)
        swap = chain = -1.0
        for i, j in itertools.combinations(range(9), 2):
            x = labels.copy()
            x[i], x[j] = x[j], x[i]
            swap = max(swap, _value(a, x) - now)
        for i, j, k in itertools.product(range(0, 9, 3), range(1, 9, 3), range(2, 9, 3)):
            for turn in ((1, 2, 0), (2, 0, 1)):
                x = labels.copy()
                x[[i, j, k]] = turn
                chain = max(chain, _value(a, x) - now)
        if swap <= 1e-9 < 1e-3 < chain:
            yield a, labels


def test_chains_are_exact_and_help_where_swaps_stall(spark):
    helped = False
    for a, labels in itertools.islice(_stalled(), 4):
        e = graph(spark, [(u, v, a[u, v]) for u, v in itertools.combinations(range(9), 2) if a[u, v]])
        state, arcs = ml.start(e, nodes(spark, 9))
        state = state.drop("community").join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "node bigint, community bigint"), "node")
        now = _value(a, labels)
        for r in ml.chains(state, arcs, 1, 9).collect():
            x = labels.copy()
            x[r["n1"]], x[r["n2"]] = r["c2"], r["c3"]
            if r["closed"]:
                x[r["n3"]] = r["c1"]
            assert abs(_value(a, x) - now - r["gain"]) < 1e-9
        assert ml.swap_round(state, arcs, 0).filter("moved").isEmpty()
        after = ml.chain_round(state, arcs, 3, 3)
        moved = np.array([r["community"] for r in after.orderBy("node").collect()])
        assert sorted(np.bincount(moved)) == [3, 3, 3] and _value(a, moved) >= now - 1e-12
        if _value(a, moved) > now + 1e-9:
            helped = True
            break
    assert helped
