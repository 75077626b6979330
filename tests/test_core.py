"""Small graphs with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from partflow.functions import metrics as me
from partflow.functions.lp import maximise
from partflow.functions.partition import coassociation, relabel_first
from partflow.operators import contract as co
from partflow.operators import kernels as ke
from partflow.operators.community import bfs_levels, heavy_edge_matching, orbits, quantize
from partflow.operators.components import connected_components
from partflow.plans.decomposition import Config, Graph, Record, Result, decompose, solve_master
from partflow.plans.workflows import DETECTORS, core_periphery, detect, load_balance, project
from partflow.sources.graphs import map_pairs, unit_diagonal
from partflow.sources.tables import canonical


def edges(spark, *rows):
    return canonical(spark.createDataFrame([(u, v, float(w[0]) if w else 1.0) for u, v, *w in rows], "src bigint, dst bigint, w double"))


def member(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "node bigint, community bigint")


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "u bigint, v bigint")


def cliques(sizes):
    rows, at = [], 0
    for n in sizes:
        rows += [(i, j) for i in range(at, at + n) for j in range(i + 1, at + n)]
        if at:
            rows.append((at - 1, at))
        at += n
    return rows


def test_contraction_keeps_modularity(spark):
    e = edges(spark, (0, 1), (0, 2), (1, 2), (2, 3))
    nodes = spark.range(4).select(F.col("id").alias("node"))
    comp = co.link_components(nodes, pairs(spark, (0, 1)))
    assert [r["comp"] for r in comp.orderBy("node").collect()] == [0, 0, 1, 2]
    small = co.contract_graph(e, comp)
    part = member(spark, [0, 0, 1, 2])
    a = me.modularity(e, part).first()[0]
    b = me.modularity(small, co.contract_partition(part, comp)).first()[0]
    assert abs(a - b) < 1e-12
    got = {(r["u"], r["v"]) for r in co.contract_pairs(pairs(spark, (0, 3), (1, 2), (3, 0)), comp).collect()}
    assert got == {(0, 1), (0, 2)}
    with pytest.raises(ValueError):
        co.contract_pairs(pairs(spark, (0, 1)), comp, True)
    with pytest.raises(ValueError):
        co.contract_partition(member(spark, [0, 1, 1, 2]), comp)


def test_metrics_of_equal_partitions(spark):
    a, b = member(spark, [0, 0, 1, 1, 2, 2]), member(spark, [5, 5, 3, 3, 4, 4])
    r = me.agreement(a, b).first()
    assert abs(r["nmi"] - 1) < 1e-12 and abs(r["ari"] - 1) < 1e-12 and abs(r["vi"]) < 1e-12 and r["hamming"] == 0
    accuracy, names = me.permuted_accuracy(a, b)
    assert accuracy == 1.0 and names == {5: 0, 3: 1, 4: 2}
    assert coassociation(a).count() == 3
    assert [r["community"] for r in relabel_first(b).orderBy("node").collect()] == [0, 0, 1, 1, 2, 2]


def test_empty_graph_raises(spark):
    with pytest.raises(ValueError):
        ke.score_matrix(np.zeros((3, 3)))
    with pytest.raises(Exception, match="positive edge sum"):
        me.modularity(edges(spark, (0, 1, 0.0)), member(spark, [0, 0])).collect()


def test_components(spark):
    got = {r["node"]: r["component"] for r in connected_components(pairs(spark, (1, 2), (2, 3), (7, 7), (5, 4), (3, 9), (9, 10), (10, 11), (11, 12))).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 1, 11: 1, 12: 1, 7: 7, 4: 4, 5: 4}
    chain = {r["component"] for r in connected_components(pairs(spark, *[(i, i + 1) for i in range(60)])).collect()}
    assert chain == {0}


def test_unknown_label_raises(spark):
    nodes = spark.createDataFrame([(0, "a"), (1, "b")], "node bigint, label string")
    with pytest.raises(ValueError):
        map_pairs(spark.createDataFrame([("a", "z")], "u string, v string"), nodes)


def test_simplex_values_and_duals(spark):
    s = maximise(spark, [3, 5], [[1, 0], [0, 2], [3, 2]], ["<="] * 3, [4, 12, 18])
    assert abs(s.value - 36) < 1e-9 and np.allclose(s.x, [2, 6]) and np.allclose(s.duals, [0, 1.5, 1])
    assert maximise(spark, [1], [[1], [1]], ["<=", ">="], [1, 2]) is None


def test_master_screens_columns(spark):
    pool = [np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([0, 0, 0])]
    weights, value, duals = solve_master(spark, pool, [0.3, 0.9, 0.1], [(0, 1)], [], [])
    assert weights == {0: 1.0} and abs(value - 0.3) < 1e-9
    assert solve_master(spark, pool, [0.3, 0.9, 0.1], [(0, 1)], [(0, 1)], []) is None


def test_kernels_reach_the_optimum_of_a_small_graph():
    rng = np.random.default_rng(3)
    for _ in range(5):
        b = rng.normal(size=(7, 7))
        b = b + b.T
        top = ke.score(b, ke.best_partition(b))
        assert max(ke.score(b, ke.multistart(b, s)) for s in range(6)) > top - 1e-9
        for f in (ke.louvain, ke.spectral, ke.anneal):
            assert ke.score(b, f(b, 0)) <= top + 1e-9


def test_balanced_clique_chain(spark):
    out = load_balance(spark, edges(spark, *cliques([12, 7, 5])), 3, 0, max_iterations=2)
    assert np.bincount(out.partition).tolist() == [8, 8, 8]
    with pytest.raises(RuntimeError):
        load_balance(spark, edges(spark, *cliques([2, 2])), 3, 0, bounds=(3, 3))


def test_rules_and_large_edgeless_construction():
    rules = ke.Rules(6, [(0, 1)], [(2, 3)], 2, 2)
    x = ke.construct(rules, 3, 0)[rules.block]
    assert x[0] == x[1] and x[2] != x[3] and np.bincount(x).tolist() == [2, 2, 2]
    assert ke.construct(ke.Rules(4, [(0, 1)], [(0, 1)]), 2) is None
    assert (ke.construct(ke.Rules(300, (), (), 300, 300), 1) == 0).all()


def test_column_generation_beats_one_block(spark):
    e = edges(spark, *cliques([5, 5, 5]))
    out = decompose(spark, e, Config(algorithm="louvain", trials=2, max_iterations=3))
    assert out.value > 0.4 and len(set(out.partition)) == 3
    forced = decompose(spark, e, Config(must=((0, 14),), contract=True, trials=2, max_iterations=3))
    at = dict(zip(forced.metadata["nodes"], forced.partition, strict=True))
    assert at[0] == at[14]
    hooked = decompose(spark, e, Config(max_iterations=1), pricing=lambda b: (np.arange(len(b)), -1.0))
    assert (hooked.records[0].column == np.arange(15)).all()


def test_core_and_periphery_of_a_star(spark):
    e = edges(spark, *[(0, i) for i in range(1, 5)], (1, 2))
    got = {r["node"]: r["community"] for r in core_periphery(spark, e, method="threshold").collect()}
    assert got[0] == 0 and got[1] == got[2]
    one = core_periphery(spark, edges(spark, (0, 0)), nodes=spark.createDataFrame([(0,)], "node bigint")).collect()
    assert [(r["node"], r["community"]) for r in one] == [(0, 0)]


def test_small_steps(spark):
    e = edges(spark, (0, 1, 5), (1, 2, 1), (2, 3, 4))
    assert {(r["u"], r["v"]) for r in heavy_edge_matching(e).collect()} == {(0, 1), (2, 3)}
    assert {(r["node"], r["level"]) for r in bfs_levels(e, 0).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert [r["orbit"] for r in orbits(spark, np.ones((3, 3)) - np.eye(3)).orderBy("node").collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        quantize(edges(spark, (0, 1, -1)), 10).collect()
    with pytest.raises(ValueError):
        Graph(e).pairs([(0, 99)])
    with pytest.raises(ValueError):
        me.balance_bounds(10)
    assert me.balance_bounds(24, 3, 0) == (8, 8) and list(me.feasible_counts(10, 3, 5)) == [2, 3]


def test_signed_louvain_parts_what_the_negative_layer_parts():
    one, two = np.zeros((6, 6)), np.zeros((6, 6))
    for u, v in [(0, 1), (2, 3), (4, 5), (1, 2), (3, 4)]:
        one[u, v] = one[v, u] = 1
    two[0, 3] = two[3, 0] = two[1, 2] = two[2, 1] = 5
    labels = ke.signed_louvain([(1.0, one), (-1.0, two)])[-1]
    assert labels[1] != labels[2] and labels[0] != labels[3] and labels[0] == labels[1]
    b = ke.score_matrix(one) - ke.score_matrix(two)
    assert ke.score(b, labels) >= ke.score(b, ke.louvain(ke.score_matrix(one))) - 1e-12
    path = np.diag(np.ones(4), 1) + np.diag(np.ones(4), -1)
    assert [x.tolist() for x in ke.within_hops(path, 2)] == [[1, 2], [0, 2, 3], [0, 1, 3, 4], [1, 2, 4], [2, 3]]
    assert ke.signed_louvain([(1.0, np.zeros((3, 3))), (-1.0, np.zeros((3, 3)))])[-1].tolist() == [0, 1, 2]


def test_best_grouping_equals_enumeration():
    from partflow.operators import kernels as ke

    r = np.random.default_rng(0)
    for trial in range(12):
        b = r.standard_normal((7, 7))
        b = b + b.T
        rules, k = ke.Rules(7, ((0, 1),) if trial % 2 else (), ((0, 3), (2, 5)), *((2, 4) if trial % 3 else (1, None))), (None, 3)[trial % 2]
        fit = [x for x in ke.partitions(7) if (k is None or x.max() == k - 1) and (x[0] == x[1] or not trial % 2) and x[0] != x[3] and x[2] != x[5] and np.bincount(x).min() >= rules.low and np.bincount(x).max() <= rules.high]
        labels, proved = ke.best_grouping(b, rules, k)
        assert proved and abs(ke.score(b, labels) - max(ke.score(b, x) for x in fit)) < 1e-9
    assert ke.best_grouping(b, ke.Rules(7, ((0, 1),), ((0, 1),))) == (None, True)
    blocks = np.kron(np.eye(4), np.ones((6, 6))) * 2 - 1 + 0.1 * r.standard_normal((24, 24))
    labels, proved = ke.best_grouping((blocks + blocks.T) / 2, ke.Rules(24, (), (), 6, 6), 4)
    assert proved and (labels == np.repeat(range(4), 6)).all()


def ring(groups: int = 3, size: int = 5) -> np.ndarray:
    """Cliques in a ring, each joined to the next by one edge."""
    a = np.kron(np.eye(groups), np.ones((size, size)))
    for g in range(groups):
        i, j = g * size, ((g + 1) % groups) * size + 1
        a[i, j] = a[j, i] = 1
    np.fill_diagonal(a, 0)
    return a


@pytest.mark.parametrize("seed", range(3))
def test_infomap_finds_cliques(seed):
    assert ke.infomap(ring(), seed).tolist() == np.repeat(np.arange(3), 5).tolist()


@pytest.mark.parametrize("name", sorted(DETECTORS))
def test_detect_finds_cliques(spark, name):
    a = ring()
    e = edges(spark, *((int(i), int(j), 1.0) for i, j in zip(*np.nonzero(np.triu(a)), strict=True)))
    found = {r["node"]: r["community"] for r in detect(spark, e, name).collect()}
    assert [found[i] for i in range(15)] == np.repeat(np.arange(3), 5).tolist()


def test_kernels_take_graphs_without_edges():
    a = np.zeros((3, 3))
    assert ke.infomap(a).tolist() == [0, 1, 2]
    assert ke.walktrap(a, a).tolist() == [0, 1, 2]
    assert ke.voronoi(a, a).tolist() == [0, 1, 2]


def test_detect_refuses(spark):
    with pytest.raises(ValueError, match="no algorithm"):
        detect(spark, edges(spark, (0, 1, 1.0)), "other")
    with pytest.raises(ValueError, match="negative"):
        detect(spark, edges(spark, (0, 1, -1.0), (1, 2, 3.0)))


def test_projection_agrees_with_the_last_combination(spark):
    e = edges(spark, (0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 3, 1.0))
    pool = [np.array([0, 0, 0, 1]), np.array([0, 0, 1, 1])]
    last = Result([Record(1, 0.0, {0: 0.4, 1: 0.6}, 0.0, pool[1])], None, None, {"pool": pool})
    out = project(spark, e, last, Config(k=2, sizes=(2, 2)))
    assert out.partition.tolist() == [0, 0, 1, 1] and out.metadata["proved"]
    out = project(spark, e, last, Config(k=2, sizes=(2, 2), must=((0, 3),)))
    assert out.partition.tolist() == [0, 1, 1, 0]
    assert project(spark, e, last, Config(k=2, sizes=(2, 2), must=((0, 3), (0, 1)))).partition is None


def test_unit_diagonal(spark):
    cells = spark.createDataFrame([(0, 1, 1.0), (1, 0, 0.5), (2, 0, 4.0), (1, 1, 7.0)], "src bigint, dst bigint, w double")
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "node bigint")
    found = {(r["src"], r["dst"]): r["w"] for r in unit_diagonal(cells, nodes).collect()}
    assert found == {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0, (0, 1): 0.75, (1, 0): 0.75, (0, 2): 2.0, (2, 0): 2.0}


def test_swap_gains_with_loops(spark):
    rows = [(0, 0, 2.0), (0, 1, 1.0), (1, 2, 3.0), (2, 3, 1.0), (0, 3, 2.0), (3, 3, 1.0)]
    e, labels = edges(spark, *rows), np.array([0, 0, 1, 1])
    member = spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "node bigint, community bigint")
    b = ke.score_matrix(Graph(e).a)
    found = {(r["u"], r["v"]): r["gain"] for r in me.swap_gains(e, member).collect()}
    assert set(found) == {(1, 2), (0, 3)}
    for (u, v), gain in found.items():
        x = labels.copy()
        x[u], x[v] = labels[v], labels[u]
        assert gain == pytest.approx(ke.score(b, x) - ke.score(b, labels))
