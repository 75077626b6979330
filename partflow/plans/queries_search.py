"""Queries over case studies, masters, pricing, community detection, refinement, core-periphery and the workflows.

Search results are checked by what they must satisfy: such a query returns counts of violations, which SQL states to be 0, or values that
SQL computes by trying every partition of a tiny graph.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partflow.functions import metrics as me
from partflow.functions.lp import maximise
from partflow.functions.metrics import tidy
from partflow.operators import community as cm
from partflow.operators import contract as co
from partflow.operators import density as de
from partflow.operators import kernels as ke
from partflow.sources import casestudies as cs
from partflow.sources import graphs as gr
from partflow.sources import tables as tb

from . import workflows as wf
from .decomposition import Config, Graph, decompose, price, priced_matrix, reduced_cost, solve_master
from .queries import QUERIES, SQL, cannot_links, must_links, node_duals, pair_duals, pool, query, strong_edges, violations, with_  # noqa: F401

CP = ("y", "z")
CC = ("α", "y")

# ------------------------------------------------------------------ case studies

_CP = """t AS (SELECT unnest(range(1, nt + 1)) AS t FROM n), j AS (SELECT unnest(range(1, nj + 1)) AS j FROM n), k AS (SELECT unnest(range(1, nk + 1)) AS k FROM n),
rows AS (SELECT (t - 1) * nj + j AS id, 'DS' AS tag, 'x:' || k || ':' || j || ':' || t AS v FROM t, j, k, n
 UNION ALL SELECT nt * nj + ((t - 1) * nj + j - 1) * nk + k, 'UAC', unnest(['x:' || k || ':' || j || ':' || t, 'y:' || k || ':' || t]) FROM t, j, k, n
 UNION ALL SELECT nt * nj + nt * nj * nk + (t - 1) * nk + k, 'L', 'x:' || k || ':' || j || ':' || t FROM t, j, k, n
 UNION ALL SELECT nt * nj + nt * nj * nk + nt * nk + (t - 1) * nk + k, 'CU', 'y:' || k || ':' || t FROM t, k, n
 UNION ALL SELECT nt * nj + nt * nj * nk + nt * nk + (t.t - 1) * nk + k, 'CU', 'z:' || k || ':' || b.t FROM t, k, n, t b WHERE b.t <= t.t)"""
_CC = """j AS (SELECT unnest(range(1, nj + 1)) AS j FROM n), r AS (SELECT unnest(range(1, nk + 1)) AS r FROM n), p AS (SELECT a.j AS i, b.j AS j, row_number() OVER (ORDER BY a.j, b.j) AS n FROM j a, j b WHERE a.j < b.j),
q AS (SELECT nj, nj * (nj - 1) // 2 AS np FROM n),
rows AS (SELECT j AS id, 'CA' AS tag, 'α:' || j || ':' || r AS v FROM j, r
 UNION ALL SELECT nj + (r - 1) * (np + nj) + n, 'NO', unnest(['α:' || i || ':' || r, 'α:' || j || ':' || r, 'x:' || i || ':x:' || r, 'x:' || i || ':y:' || r, 'x:' || j || ':x:' || r, 'x:' || j || ':y:' || r]) FROM p, r, q
 UNION ALL SELECT nj + (r - 1) * (np + nj) + np + j, 'BP', unnest(['α:' || j || ':' || r, 'x:' || j || ':x:' || r, 'x:' || j || ':y:' || r]) FROM j, r, q)"""
_LINK = """SELECT a.id::BIGINT AS src, b.id::BIGINT AS dst, count(*) AS weight, CASE WHEN min((substr(a.v, 1, 1) IN {0})::INT) = 1 THEN 'integer' ELSE 'continuous' END AS var_type FROM rows a JOIN rows b ON a.v = b.v AND a.id < b.id GROUP BY 1, 2"""
_COUNTS = "n AS (SELECT (SELECT count(*) FROM supplier) AS nk, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS nj, (SELECT count(DISTINCT year(o_orderdate)) FROM orders) AS nt)"


def plan_sizes(s: SparkSession, d: str, units: str = "supplier") -> tuple[int, int, int]:
    """How many units, products (market segments) and periods (years) the tables ask a plan for."""
    return (
        tb.table(s, d, units).count(),
        tb.table(s, d, "customer").select("c_mktsegment").distinct().count(),
        tb.table(s, d, "orders").select(F.year("o_orderdate")).distinct().count(),
    )


query("cpcong_nodes", "", f"WITH {_COUNTS}, {_CP} SELECT DISTINCT id::BIGINT AS \"constraint\", tag, '$' || tag || '_{{' || id || '}}$' AS label FROM rows")(lambda s, d: cs.capacity_planning(s, *plan_sizes(s, d)).select("constraint", "tag", "label"))
query("cpcong_edges", "", f"WITH {_COUNTS}, {_CP} " + _LINK.format("('y', 'z')"))(lambda s, d: cs.constraint_graph(cs.capacity_planning(s, *plan_sizes(s, d)), CP).select("src", "dst", "weight", "var_type"))
query("circcut_nodes", "", f"WITH {_COUNTS}, {_CC} SELECT DISTINCT id::BIGINT AS \"constraint\", tag, tag || id AS label FROM rows")(lambda s, d: _cutting(s, d).select("constraint", "tag", "label"))
query("circcut_edges", "", f"WITH {_COUNTS}, {_CC} " + _LINK.format("('α', 'y')"))(lambda s, d: cs.constraint_graph(_cutting(s, d), CC).select("src", "dst", "weight", "var_type"))


def _cutting(s: SparkSession, d: str) -> DataFrame:
    """Market segments are the circles, suppliers the rectangles to cut them from."""
    rectangles, circles, _ = plan_sizes(s, d)
    return cs.circle_cutting(s, circles, rectangles)


# ------------------------------------------------------------------ orders and generation

query("degree_order", "strong nodes", "SELECT node, row_number() OVER (ORDER BY coalesce(k, 0) DESC, node DESC) - 1 AS pos FROM nodes LEFT JOIN (SELECT n, count(*) AS k FROM (SELECT src AS n FROM strong UNION ALL SELECT dst FROM strong) GROUP BY 1) ON n = node")(lambda s, d: cm.degree_order(strong_edges(s, d), tb.nation_nodes(s, d)))
SQL["bfs_levels"] = with_("nodes strong", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """, y AS (SELECT src, dst FROM strong UNION ALL SELECT dst, src FROM strong), b AS (SELECT 0::BIGINT AS node, 0 AS level UNION SELECT y.dst, level + 1 FROM b JOIN y ON src = b.node WHERE level < 24) SELECT node, min(level)::INT AS level FROM b GROUP BY 1"""
query("bfs_levels")(lambda s, d: cm.bfs_levels(strong_edges(s, d), 0))
query("dfs_order")(lambda s, d: cm.dfs_order(s, Graph(strong_edges(s, d), tb.nation_nodes(s, d))))
query("balanced_chunks", "nodes", "SELECT node, CASE WHEN p < 7 THEN 0 ELSE (p - 1) // 6 END::BIGINT AS community FROM (SELECT node, row_number() OVER (ORDER BY node DESC) - 1 AS p FROM nodes)")(
    lambda s, d: cm.balanced_chunks(tb.nation_nodes(s, d).select("node", (24 - F.col("node")).alias("pos")), 4)
)
query("conflict_degree", "cannot nodes", "SELECT node, (SELECT count(*) FROM cannot WHERE u = node OR v = node) AS degree FROM nodes")(
    lambda s, d: tb.nation_nodes(s, d).select("node").join(cannot_links(s).select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
)
query("topk_blocks_per_group", "deg mem", "SELECT node, community, r FROM (SELECT node, community, row_number() OVER (PARTITION BY community ORDER BY a DESC, node) AS r FROM mem JOIN deg USING (node)) WHERE r <= 2")(
    lambda s, d: tb.regions(s, d).join(gr.degrees(tb.nation_trade(s, d)), "node").withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("a"), "node")).cast("long")).filter("r <= 2").select("node", "community", "r")
)
query("k_control", "nodes", "SELECT unnest(range(ceil(count(*) / 7.0)::BIGINT, least(count(*) // 3, ceil(count(*) / 7.0)::BIGINT + 2) + 1))::INT AS k FROM nodes")(lambda s, d: s.createDataFrame([(k,) for k in list(me.feasible_counts(tb.nation_nodes(s, d).count(), 3, 7))[:3]], "k int"))


def _report(s: SparkSession, **counts) -> DataFrame:
    return s.createDataFrame([tuple(int(v) for v in counts.values())], ", ".join(f"{k} bigint" for k in counts))


def _broken(rules: ke.Rules, labels: np.ndarray | None) -> int:
    if labels is None:
        return -1
    heads = {int(b): int(c) for b, c in zip(rules.block, labels, strict=True)}
    apart = int(sum(heads[int(b)] != c for b, c in zip(rules.block, labels, strict=True)))
    return apart + rules.broken(np.array([heads[b] for b in range(len(rules.size))]))


MUST, CANNOT = ((0, 1), (1, 2)), ((0, 3), (4, 9))


def _rules(n: int, low: int = 1, high: int | None = None) -> ke.Rules:
    return ke.Rules(n, MUST, CANNOT, low, high)


def _generator(name: str, sizes: tuple[int, int] | None, k: int | None, ordered: bool, trials: int = 4):
    def run(s: SparkSession, d: str) -> DataFrame:
        g = Graph(tb.nation_trade(s, d))
        rules = _rules(len(g.nodes), *(sizes or (1, None)))
        found = []
        for seed in range(trials):
            order = np.argsort(-rules.size, kind="stable") if ordered else None
            x = ke.construct(rules, k, seed, order=order)
            found.append(None if x is None else x[rules.block])
        return _report(s, columns=len({tuple(x) for x in found if x is not None}) > 0, violations=sum(_broken(rules, x) for x in found))

    query(name, "", "SELECT 1::BIGINT AS columns, 0::BIGINT AS violations")(run)


for _n, _s, _k, _o in (("greedy_coloring", None, None, True), ("links_only_assign", None, None, True), ("ifc_links_only", None, 4, True), ("ifc_random_links", None, 4, False), ("balanced_assign", (5, 5), 5, False), ("ifc_balanced", (6, 7), 4, False), ("mrv_partition", (5, 5), 5, False), ("ifc_random_balanced", (4, 8), 4, False)):
    _generator(_n, _s, _k, _o)

# ------------------------------------------------------------------ optima of eight nodes, which SQL finds by trying every partition

EIGHT_MUST, EIGHT_CANNOT = ((0, 1),), ((0, 3), (4, 6))
_MODULARITY = """sub AS (SELECT src AS u, dst AS v, w FROM sym WHERE src < 8 AND dst < 8), i AS (SELECT unnest(range(0, 8)) AS u),
a AS (SELECT i.u, coalesce(sum(w), 0) AS a FROM i LEFT JOIN sub USING (u) GROUP BY 1), m AS (SELECT sum(a) AS m FROM a),
b AS MATERIALIZED (SELECT x.u, y.u AS v, coalesce(w, 0) / m - x.a * y.a / (m * m) AS b FROM a x CROSS JOIN a y CROSS JOIN m LEFT JOIN sub ON sub.u = x.u AND sub.v = y.u)"""
_DENSITY = """i AS (SELECT unnest(range(0, 8)) AS u),
b AS MATERIALIZED (SELECT x.u, y.u AS v, coalesce(w, 0) - q AS b FROM i x JOIN i y ON x.u <> y.u CROSS JOIN med LEFT JOIN sym ON src = x.u AND dst = y.u)"""
_GROUPS = "(SELECT {0}(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(x) AS g) GROUP BY g))"


def _best_sql(matrix: str, where: str = "true", low: int = 1, high: int = 8, k: int | None = None, more: str = "", needs: str = "sym med") -> str:
    """The best score over partitions of nodes 0..7 into communities of low..high nodes, k of them if given."""
    sizes = f"{_GROUPS.format('min')} >= {low} AND {_GROUPS.format('max')} <= {high}" + (f" AND list_max(x) = {k - 1}" if k else "")
    links = " AND ".join([f"x[{u + 1}] = x[{v + 1}]" for u, v in EIGHT_MUST] + [f"x[{u + 1}] <> x[{v + 1}]" for u, v in EIGHT_CANNOT]) if where == "links" else where
    body = f""", {matrix}, n AS (SELECT unnest(range(0, 8)) AS c),
r AS (SELECT 1 AS len, [0] AS x, 0 AS top UNION ALL SELECT len + 1, list_append(x, c), greatest(top, c) FROM r, n WHERE len < 8 AND c <= top + 1),
p AS (SELECT row_number() OVER () AS id, x FROM r WHERE len = 8 AND {links} AND {sizes}),
f AS (SELECT id, sum(b) AS f FROM p, b WHERE x[u + 1] = x[v + 1] OR (u = 0 AND v = 0) GROUP BY id)
SELECT {more}round(coalesce(max(f), 0), 6) + 0.0 AS optimum FROM f"""
    return with_(needs, "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + body


def eight(s: SparkSession, d: str) -> tuple[DataFrame, Graph]:
    """The trade graph of the first eight nations."""
    e = tb.nation_trade(s, d).filter("src < 8 and dst < 8")
    return e, Graph(e, tb.nation_nodes(s, d).filter("node < 8"))


def _median(s: SparkSession, d: str) -> float:
    return tb.nation_trade(s, d).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY w)").alias("q")).first()["q"]


def by_modularity(s: SparkSession, d: str, find) -> float:
    """The modularity, by a Spark plan, of the labels that find(adjacency, scores) gives for the eight nations."""
    e, g = eight(s, d)
    return round(float(me.modularity(e, g.membership(s, find(g.a, ke.score_matrix(g.a)))).first()["modularity"]), 6) + 0.0


def by_density(s: SparkSession, d: str, find) -> float:
    """Twice the weight over the median weight that the labels keep inside communities, by a Spark plan."""
    e, g = eight(s, d)
    q = float(_median(s, d))
    labels = find(g.a, (g.a - q) * (1 - np.eye(len(g.a))))
    return round(2 * float(cm.cpm_quality(e, g.membership(s, labels), q).first()["quality"]), 6) + 0.0


def _with_optimum(df: DataFrame, value: float) -> DataFrame:
    return df.withColumn("optimum", F.lit(value))


# ------------------------------------------------------------------ masters and pricing


def _duals(s: SparkSession, d: str, g: Graph) -> dict:
    node = np.zeros(len(g.nodes))
    for r in node_duals(s, d).collect():
        if r["node"] in g.at:
            node[g.at[r["node"]]] = r["value"]
    pairs = {(g.at[r["u"]], g.at[r["v"]]): r["value"] for r in pair_duals(s, d).collect() if r["u"] in g.at and r["v"] in g.at}
    return {"constant": 0.125, "node": node, "pairs": pairs}


_PRICED = _MODULARITY.replace("b AS MATERIALIZED", "plain AS") + """,
b AS MATERIALIZED (SELECT plain.u, plain.v, plain.b - (x.value + y.value) / 2 - coalesce(p.value, 0) / 2 AS b
 FROM plain JOIN ndual x ON x.node = plain.u JOIN ndual y ON y.node = plain.v LEFT JOIN pdual p ON p.u = least(plain.u, plain.v) AND p.v = greatest(plain.u, plain.v))"""


def by_price(s: SparkSession, d: str, find) -> float:
    """The reduced cost, by a Spark plan and without the constant, of the labels that find(graph, scores, duals) gives for the eight nations."""
    e, g = eight(s, d)
    pairs = pair_duals(s, d).filter("u < 8 and v < 8")
    labels = find(g, ke.score_matrix(g.a), _duals(s, d, g))
    return round(float(me.reduced_cost(e, g.membership(s, labels), node_duals(s, d).filter("node < 8"), pairs, 0.0).first()["reduced_cost"]), 6) + 0.0


def _pool(s: SparkSession, d: str) -> tuple[Graph, np.ndarray, list[np.ndarray], list[float]]:
    g = Graph(tb.nation_trade(s, d))
    b = ke.score_matrix(g.a)
    rows = pool(s, d).collect()
    columns = [np.array([c for _, c in sorted((g.at[r["node"]], r["community"]) for r in rows if r["part_id"] == k)]) for k in (1, 2, 3)]
    columns.append(np.zeros(len(g.nodes), np.int64))
    return g, b, columns, [ke.score(b, x) for x in columns]


_BEST = "SELECT round(max(f), 9) + 0.0 AS value FROM (SELECT part_id, sum(w_in / m - (t / m) * (t / m)) AS f FROM (SELECT p.part_id, p.community, sum(a) AS t, max(m) AS m, (SELECT coalesce(sum(w), 0) FROM sym JOIN pool x ON src = x.node AND x.part_id = p.part_id AND x.community = p.community JOIN pool y ON dst = y.node AND y.part_id = p.part_id AND y.community = p.community) AS w_in FROM pool p JOIN deg USING (node), vol GROUP BY 1, 2) GROUP BY 1 UNION ALL SELECT 4, 0.0) WHERE part_id NOT IN (SELECT part_id FROM pool x JOIN pool y USING (part_id) JOIN cannot ON u = x.node AND v = y.node WHERE x.community = y.community) AND part_id <> 4"
query("master_integer", "sym deg vol pool cannot", _BEST)(lambda s, d: _master(s, d, True))
query("master_lp_objective", "sym deg vol pool cannot", _BEST)(lambda s, d: _master(s, d, False))


def _master(s: SparkSession, d: str, integer: bool) -> DataFrame:
    g, _, columns, scores = _pool(s, d)
    value = solve_master(s, columns, scores, [], g.pairs(CANNOT), [], integer=integer)
    return s.createDataFrame([(round(float(value[1]), 9) + 0.0,) if value else (None,)], "value double")


@query("master_duals", "", "SELECT 0::BIGINT AS infeasible, 0::BIGINT AS gap")
def _master_duals(s, d):
    g, b, columns, scores = _pool(s, d)
    _, value, duals = solve_master(s, columns, scores, [], g.pairs(CANNOT), [])
    costs = [reduced_cost(b, duals, x) + 0 for x in columns]
    bound = duals["constant"] + 0.0
    return _report(s, infeasible=sum(c > 1e-7 for c in costs), gap=abs(bound - value) > 1e-7)


query("lb_master_coeffs", "pool", "SELECT part_id, node, count(*) OVER (PARTITION BY part_id, community) AS size FROM pool")(lambda s, d: pool(s, d).select("part_id", "node", F.count(F.lit(1)).over(Window.partitionBy("part_id", "community")).alias("size")))


@query("lb_master", "", "SELECT 0::BIGINT AS violations, 0::BIGINT AS gap")
def _lb_master(s, d):
    g, b, columns, scores = _pool(s, d)
    low, high = 4, 9
    weights, value, duals = solve_master(s, columns, scores, [], [], [], (low, high))
    size = np.array([np.bincount(x)[x] for x in columns])
    mean = sum(w * size[k] for k, w in weights.items())
    dual = maximise(s, scores, [np.ones(len(columns)), *size.T, *size.T], ["="] + [">="] * len(mean) + ["<="] * len(mean), [1.0] + [low] * len(mean) + [high] * len(mean))
    return _report(s, violations=int(((mean < low - 1e-7) | (mean > high + 1e-7)).sum()), gap=abs(dual.value - value) > 1e-7)


query("dual_adjusted_edges", "edges vol ndual pdual", "SELECT src, dst, round(w - m * ((a.value + b.value) / 2 + coalesce(p.value, 0) / 2), 6) + 0.0 AS w FROM edges CROSS JOIN vol JOIN ndual a ON src = a.node JOIN ndual b ON dst = b.node LEFT JOIN pdual p ON p.u = src AND p.v = dst")(
    lambda s, d: cm.dual_adjusted(tb.nation_trade(s, d), node_duals(s, d), pair_duals(s, d)).withColumn("w", tidy(F.col("w"), 6))
)


def _pricing(name: str, algorithm: str):
    four = algorithm == "balanced"

    @query(name, "", _best_sql(_PRICED, "true", *((4, 4, 2) if four else ()), more="0::BIGINT AS mismatches, 1::BIGINT AS found, ", needs="sym med ndual pdual"))
    def run(s, d):
        g = Graph(tb.nation_trade(s, d))
        b, duals = ke.score_matrix(g.a), _duals(s, d, g)
        labels, cost = price(s, b, duals, Config(algorithm=algorithm, k=5, trials=3), ke.Rules(len(b), (), (), 5, 5) if algorithm == "balanced" else ke.Rules(len(b)))
        again = me.reduced_cost(tb.nation_trade(s, d), g.membership(s, labels), node_duals(s, d), pair_duals(s, d), 0.125).first()["reduced_cost"]
        config = Config(algorithm=algorithm, k=2, trials=8)
        least = by_price(s, d, lambda g, b, duals: price(s, b, duals, config, ke.Rules(8, (), (), 4, 4) if four else ke.Rules(8))[0])
        return _with_optimum(_report(s, mismatches=abs(again - cost) > 1e-9, found=labels is not None), least)


for _n, _a in (("pricing_heuristic", "louvain"), ("pricing_custom", "multistart"), ("pricing_balanced", "balanced")):
    _pricing(_n, _a)

query("exact_pricing", "", _best_sql(_PRICED, needs="sym med ndual pdual"))(
    lambda s, d: s.createDataFrame([(by_price(s, d, lambda g, b, duals: ke.best_grouping(priced_matrix(b, duals), ke.Rules(8))[0]),)], "optimum double")
)
query("exact_grouping", "", _best_sql(_MODULARITY, "links"))(
    lambda s, d: s.createDataFrame([(by_modularity(s, d, lambda a, b: ke.best_grouping(b, ke.Rules(8, EIGHT_MUST, EIGHT_CANNOT))[0]),)], "optimum double")
)
query("project_partition", "", _best_sql(_MODULARITY, "links", 2, 3, 3))(
    lambda s, d: s.createDataFrame([(by_modularity(s, d, lambda a, b: ke.best_grouping(b, ke.Rules(8, EIGHT_MUST, EIGHT_CANNOT, 2, 3), 3)[0]),)], "optimum double")
)


@query("fractional_pairs", "pool", "SELECT x.node AS i, y.node AS j, round(sum(CASE part_id WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END::DOUBLE), 9) AS share FROM pool x JOIN pool y USING (part_id, community) WHERE x.node < y.node GROUP BY 1, 2")
def _fractional(s, d):
    p = pool(s, d).join(s.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.2)], "part_id int, weight double"), "part_id")
    a, b = p.alias("a"), p.alias("b")
    both = a.join(b, (F.col("a.part_id") == F.col("b.part_id")) & (F.col("a.community") == F.col("b.community"))).filter("a.node < b.node")
    return both.groupBy(F.col("a.node").alias("i"), F.col("b.node").alias("j")).agg(F.round(F.sum("a.weight"), 9).alias("share"))


# ------------------------------------------------------------------ community detection


def _detect(name: str, kernel, reaches: bool = True):
    """On the whole graph labels no worse than singles, rescored by a plan; on eight nations the optimum of the density score, where the
    algorithm takes any score."""
    constant = "0::BIGINT AS mismatches, 0::BIGINT AS worse_than_singles"

    @query(name, "", _best_sql(_DENSITY, more=constant + ", ") if reaches else "SELECT " + constant)
    def run(s, d):
        e = strong_edges(s, d)
        g = Graph(e, tb.nation_nodes(s, d))
        b = ke.score_matrix(g.a)
        labels = kernel(g.a, b)
        again = me.modularity(e, g.membership(s, labels)).first()["modularity"]
        out = _report(s, mismatches=abs(again - ke.score(b, labels)) > 1e-9, worse_than_singles=ke.score(b, labels) < b.trace() - 1e-12)
        return _with_optimum(out, by_density(s, d, kernel)) if reaches else out


for _n, _f in (
    ("louvain", lambda a, b: ke.louvain(b)), ("leiden", lambda a, b: ke.louvain(b, 0, True)), ("greedy_modularity", lambda a, b: ke.greedy_merges(b)), ("spectral_bisection", lambda a, b: ke.spectral(b)),
    ("rccs", lambda a, b: ke.multistart(b)), ("spinglass", lambda a, b: ke.anneal(b)), ("girvan_newman", lambda a, b: ke.girvan_newman(a, b, 3)),
):
    _detect(_n, _f, _n != "girvan_newman")


_SIGNED_EIGHT = """i AS (SELECT unnest(range(0, 8)) AS u), s AS (SELECT src AS u, dst AS v, sign(w - q) AS s, abs(w - q) AS w FROM sym, med WHERE w <> q AND src < 8 AND dst < 8),
l AS (SELECT s, sum(w) AS m FROM s GROUP BY 1), a AS (SELECT s, u, sum(w) AS a FROM s GROUP BY 1, 2),
b AS MATERIALIZED (SELECT x.u, y.u AS v, sum(coalesce(l.s * (coalesce(w, 0) / m - coalesce(p.a, 0) * coalesce(q.a, 0) / (m * m)), 0)) AS b
 FROM i x CROSS JOIN i y CROSS JOIN l LEFT JOIN s ON s.s = l.s AND s.u = x.u AND s.v = y.u LEFT JOIN a p ON p.s = l.s AND p.u = x.u LEFT JOIN a q ON q.s = l.s AND q.u = y.u GROUP BY 1, 2)"""


@query("signed_louvain", "", _best_sql(_SIGNED_EIGHT, more="0::BIGINT AS mismatches, 0::BIGINT AS worse_than_singles, "))
def _signed_louvain(s, d):
    layers, nodes, weights = QUERIES["signed_layers"](s, d), tb.nation_nodes(s, d), {0: 1.0, 1: -1.0}
    graphs = [(w, Graph(layers.filter(F.col("layer") == k).select("src", "dst", "w"), nodes)) for k, w in weights.items()]
    b = sum(w * ke.score_matrix(g.a) for w, g in graphs)
    labels = ke.signed_louvain([(w, g.a) for w, g in graphs])[-1]
    again = me.signed_modularity(layers, graphs[0][1].membership(s, labels), weights).first()["signed_modularity"]
    out = _report(s, mismatches=abs(again - ke.score(b, labels)) > 1e-9, worse_than_singles=ke.score(b, labels) < b.trace() - 1e-12)
    few, eight_nodes = layers.filter("src < 8 and dst < 8"), nodes.filter("node < 8")
    small = [(w, Graph(few.filter(F.col("layer") == k).select("src", "dst", "w"), eight_nodes)) for k, w in weights.items()]
    matrices = [(w, g.a) for w, g in small]
    found = [ke.signed_louvain(matrices, seed=seed)[-1] for seed in range(8)]
    total = sum(w * ke.score_matrix(a) for w, a in matrices if a.any())
    best = max(found, key=lambda x: ke.score(total, x))
    value = me.signed_modularity(few, small[0][1].membership(s, best), weights).first()["signed_modularity"]
    return _with_optimum(out, round(float(value), 6) + 0.0)


@query("louvain_dual", "", _best_sql(_PRICED, more="0::BIGINT AS mismatches, 0::BIGINT AS worse_than_singles, ", needs="sym med ndual pdual"))
def _louvain_dual(s, d):
    g = Graph(tb.nation_trade(s, d))
    duals = _duals(s, d, g)
    w = priced_matrix(ke.score_matrix(g.a), duals)
    labels = ke.louvain(w)
    again = me.reduced_cost(tb.nation_trade(s, d), g.membership(s, labels), node_duals(s, d), pair_duals(s, d), 0.125).first()["reduced_cost"]
    out = _report(s, mismatches=abs(again - (ke.score(w, labels) - 0.125)) > 1e-9, worse_than_singles=ke.score(w, labels) < w.trace() - 1e-12)

    def search(g, b, duals):
        w = priced_matrix(b, duals)
        return max((ke.louvain(w, seed) for seed in range(8)), key=lambda x: ke.score(w, x))

    return _with_optimum(out, by_price(s, d, search))


@query("leiden_cpm", "", _best_sql(_DENSITY, more="0::BIGINT AS mismatches, "))
def _cpm(s, d):
    e = strong_edges(s, d)
    g = Graph(e, tb.nation_nodes(s, d))
    b = g.a - 20.0 * (1 - np.eye(len(g.a)))
    labels = ke.louvain(b, 0, True)
    again = cm.cpm_quality(e, g.membership(s, labels), 20.0).first()["quality"]
    return _with_optimum(_report(s, mismatches=abs(again - ke.score(b, labels) / 2) > 1e-6), by_density(s, d, lambda a, b: ke.louvain(b, 0, True)))


SQL["edge_betweenness"] = with_("nodes strong", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """, y AS (SELECT src, dst FROM strong UNION ALL SELECT dst, src FROM strong),
reach AS (SELECT node AS s, node AS t, 0 AS level FROM nodes UNION SELECT s, dst, level + 1 FROM reach JOIN y ON src = t WHERE level < 24),
far AS (SELECT s, t, min(level) AS l FROM reach GROUP BY 1, 2),
p AS (SELECT node AS s, node AS t, [node] AS x FROM nodes UNION ALL SELECT p.s, dst, list_append(x, dst) FROM p JOIN y ON src = p.t JOIN far ON far.s = p.s AND far.t = dst AND far.l = len(x)),
q AS (SELECT x, 1.0::DOUBLE / count(*) OVER (PARTITION BY s, t) AS share FROM p WHERE s < t),
r AS (SELECT x, share, unnest(range(1, len(x))) AS i FROM q)
SELECT least(x[i], x[i + 1]) AS src, greatest(x[i], x[i + 1]) AS dst, round(sum(share), 6) + 0.0 AS betweenness FROM r GROUP BY 1, 2"""


_LPA = "SELECT node, label FROM (SELECT src AS node, {0}.label, row_number() OVER (PARTITION BY src ORDER BY sum(w) DESC, {0}.label) AS r FROM y JOIN {0} ON {0}.node = dst GROUP BY 1, 2) WHERE r = 1"
SQL["lpa_round3"] = with_("strong", "").rstrip() + ", y AS (SELECT src, dst, w FROM strong UNION ALL SELECT dst, src, w FROM strong), l0 AS (SELECT DISTINCT src AS node, src AS label FROM y), " + f"l1 AS ({_LPA.format('l0')}), l2 AS ({_LPA.format('l1')}), l3 AS ({_LPA.format('l2')}) SELECT node, label FROM l3"
query("lpa_round3")(lambda s, d: cm.label_propagation(strong_edges(s, d), 3))
query("greedy_merge_gain", "edges deg vol", "SELECT src AS a, dst AS b, round(2 * (w / m - x.a * y.a / (m * m)), 12) + 0.0 AS gain FROM edges CROSS JOIN vol JOIN deg x ON src = x.node JOIN deg y ON dst = y.node ORDER BY 3 DESC, 1, 2 LIMIT 1")(
    lambda s, d: cm.best_merge(tb.nation_trade(s, d)).withColumn("gain", tidy(F.col("gain"), 12))
)
query("best_node_move", "", None)(lambda s, d: me.move_gains(tb.nation_trade(s, d), tb.regions(s, d)).withColumn("gain", tidy(F.col("gain"), 12)).orderBy(F.desc("gain"), "node", "to").limit(1))
SQL["best_node_move"] = SQL["move_gains"] + " ORDER BY 3 DESC, 1, 2 LIMIT 1"
query("random_walk_t3", "sym deg", "SELECT a.src AS u, c.dst AS v, round(sum((a.w / x.a) * (b.w / y.a) * (c.w / z.a)), 9) + 0.0 AS p FROM sym a JOIN sym b ON a.dst = b.src JOIN sym c ON b.dst = c.src JOIN deg x ON a.src = x.node JOIN deg y ON b.src = y.node JOIN deg z ON c.src = z.node GROUP BY 1, 2")(
    lambda s, d: cm.random_walk(tb.nation_trade(s, d), 3).withColumn("p", tidy(F.col("p")))
)
query("map_equation", "tot ins deg vol", "SELECT round(plogp(sum(q)) - 2 * sum(plogp(q)) - (SELECT sum(plogp(a / m)) FROM deg, vol) + sum(plogp(q + p)), 9) + 0.0 AS codelength FROM (SELECT total / m AS p, (total - coalesce(inside, 0)) / m AS q FROM tot LEFT JOIN ins USING (community) CROSS JOIN vol)".replace("plogp(sum(q))", "sum(q) * log2(sum(q))").replace("plogp(q + p)", "(q + p) * log2(q + p)").replace("plogp(q)", "(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END)").replace("plogp(a / m)", "a / m * log2(a / m)"))(
    lambda s, d: cm.map_equation(tb.nation_trade(s, d), tb.regions(s, d)).select(tidy(F.col("codelength")).alias("codelength"))
)
_CODE = """n AS (SELECT unnest(range(0, 8)) AS c), sub AS (SELECT src AS u, dst AS v, w FROM sym WHERE src < 8 AND dst < 8), m AS (SELECT sum(w) AS m FROM sub),
a AS (SELECT u, sum(w) / max(m) AS a FROM sub, m GROUP BY 1),
r AS (SELECT 1 AS len, [0] AS x, 0 AS top UNION ALL SELECT len + 1, list_append(x, c), greatest(top, c) FROM r, n WHERE len < 8 AND c <= top + 1),
p AS (SELECT row_number() OVER () AS id, x FROM r WHERE len = 8),
t AS (SELECT id, x[u + 1] AS g, sum(a) AS p FROM p, a GROUP BY 1, 2),
o AS (SELECT id, x[u + 1] AS g, sum(CASE WHEN x[u + 1] <> x[v + 1] THEN w ELSE 0 END) / max(m) AS q FROM p, sub, m GROUP BY 1, 2),
f AS (SELECT id, sum(q) AS s, sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) AS ql, sum((q + p) * log2(q + p)) AS qp FROM t JOIN o USING (id, g) GROUP BY 1)
SELECT round(min(CASE WHEN s > 1e-12 THEN s * log2(s) ELSE 0 END - 2 * ql + qp) - (SELECT sum(a * log2(a)) FROM a), 6) + 0.0 AS codelength FROM f"""
SQL["infomap"] = with_("sym", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _CODE


@query("infomap")
def _infomap(s, d):
    """The shortest code of eight trials on the eight nations, by a Spark plan."""
    e, g = eight(s, d)
    found = [cm.map_equation(e, g.membership(s, x)).first()["codelength"] for x in {tuple(ke.infomap(g.a, seed).tolist()) for seed in range(8)}]
    return s.createDataFrame([(round(float(min(found)), 6) + 0.0,)], "codelength double")


query("upper_triangle", "sym deg", "SELECT src, dst, round(w / a, 12) + 0.0 AS w FROM sym JOIN deg ON src = node WHERE src < dst")(
    lambda s, d: gr.upper_triangle(cm.random_walk(tb.nation_trade(s, d), 1).select(F.col("u").alias("src"), F.col("v").alias("dst"), tidy(F.col("p"), 12).alias("w")))
)
query("unit_diagonal", "sym deg nodes", "SELECT x.node AS src, y.node AS dst, round(CASE WHEN x.node = y.node THEN 1 ELSE w / 2 / x.a + w / 2 / y.a END, 9) + 0.0 AS w FROM deg x CROSS JOIN deg y LEFT JOIN sym ON src = x.node AND dst = y.node WHERE x.node = y.node OR w IS NOT NULL")(
    lambda s, d: gr.unit_diagonal(cm.random_walk(tb.nation_trade(s, d), 1).select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("p").alias("w")), tb.nation_nodes(s, d)).withColumn("w", tidy(F.col("w")))
)
query("cpm_quality", "edges mem", "SELECT round((SELECT sum(w) FROM edges JOIN mem a ON src = a.node JOIN mem b ON dst = b.node WHERE a.community = b.community) - 0.5 * sum(n * (n - 1) / 2), 6) + 0.0 AS quality FROM (SELECT count(*)::DOUBLE AS n FROM mem GROUP BY community)")(lambda s, d: cm.cpm_quality(tb.nation_trade(s, d), tb.regions(s, d), 0.5).select(tidy(F.col("quality"), 6).alias("quality")))
query("surprise_quality", "strong mem", "SELECT round(m * (CASE WHEN q > 0 THEN q * ln(q / e) ELSE 0 END + (CASE WHEN q < 1 THEN (1 - q) * ln((1 - q) / (1 - e)) ELSE 0 END)), 6) + 0.0 AS quality FROM (SELECT count(*)::DOUBLE AS m, sum((a.community = b.community)::INT)::DOUBLE / count(*) AS q FROM strong JOIN mem a ON src = a.node JOIN mem b ON dst = b.node), (SELECT sum(n * (n - 1) / 2) / (max(t) * (max(t) - 1) / 2) AS e FROM (SELECT count(*)::DOUBLE AS n, (SELECT count(*) FROM mem)::DOUBLE AS t FROM mem GROUP BY community))")(
    lambda s, d: cm.surprise_quality(strong_edges(s, d), tb.regions(s, d)).select(tidy(F.col("quality"), 6).alias("quality"))
)
_SIGNED = "SELECT round(sum(CASE WHEN s > 0 THEN q ELSE -q END), 9) + 0.0 AS signed_modularity FROM (SELECT s, sum(i / v - (t / v) * (t / v)) AS q FROM (SELECT s, community, sum(t) AS t, sum(i) AS i, max(v) AS v FROM (SELECT s, z.community, w AS t, CASE WHEN z.community = y.community THEN w ELSE 0 END AS i, sum(w) OVER (PARTITION BY s) AS v FROM (SELECT src, dst, sign(w - q) AS s, abs(w - q) AS w FROM sym, med WHERE w <> q) JOIN mem z ON src = z.node JOIN mem y ON dst = y.node) GROUP BY 1, 2) GROUP BY 1)"
query("signed_modularity", "sym med mem", _SIGNED)(lambda s, d: me.signed_modularity(QUERIES["signed_layers"](s, d), tb.regions(s, d), {0: 1.0, 1: -1.0}).select(tidy(F.col("signed_modularity")).alias("signed_modularity")))
query("signed_quality", "sym med mem", _SIGNED.replace("signed_modularity", "quality"))(lambda s, d: me.signed_modularity(QUERIES["signed_layers"](s, d), tb.regions(s, d), {0: 1.0, 1: -1.0}).select(tidy(F.col("signed_modularity")).alias("quality")))
query("weakest_community", "ins tot vol mem", "SELECT community, round((coalesce(inside, 0) / m - (total / m) * (total / m)) / (n * n), 12) + 0.0 AS mean FROM tot LEFT JOIN ins USING (community) JOIN (SELECT community, count(*)::DOUBLE AS n FROM mem GROUP BY 1) USING (community) CROSS JOIN vol ORDER BY 2, 1 LIMIT 1")(
    lambda s, d: me.modularity_by_community(tb.nation_trade(s, d), tb.regions(s, d)).join(tb.regions(s, d).groupBy("community").agg(F.count(F.lit(1)).alias("n")), "community").select("community", tidy(F.col("score") / (F.col("n") * F.col("n")), 12).alias("mean")).orderBy("mean", "community").limit(1)
)


_SWAPS = """, m AS (SELECT sum(w) AS m FROM sym), i AS (SELECT node, community AS c, a FROM mem JOIN deg USING (node)),
b AS (SELECT x.node AS u, y.node AS v, x.c AS cu, y.c AS cv, coalesce(w, 0) / m - x.a * y.a / (m * m) AS b FROM i x CROSS JOIN i y CROSS JOIN m LEFT JOIN sym ON src = x.node AND dst = y.node),
e AS (SELECT src, dst, x.c AS cs, y.c AS cd FROM edges JOIN i x ON src = x.node JOIN i y ON dst = y.node WHERE x.c <> y.c),
z AS (SELECT src, dst, b, cu = cv AS was, CASE u WHEN src THEN cd WHEN dst THEN cs ELSE cu END = CASE v WHEN src THEN cd WHEN dst THEN cs ELSE cv END AS will FROM e CROSS JOIN b)
SELECT src AS u, dst AS v, round(sum(CASE WHEN will THEN b ELSE 0 END) - sum(CASE WHEN was THEN b ELSE 0 END), 9) + 0.0 AS gain FROM z GROUP BY 1, 2"""
SQL["swap_gains"] = with_("edges sym deg mem", "").rstrip() + _SWAPS
query("swap_gains")(lambda s, d: me.swap_gains(tb.nation_trade(s, d), tb.regions(s, d)).withColumn("gain", tidy(F.col("gain"))))
query("heavy_edge_matching", "sym", "SELECT x.u, x.v FROM (SELECT src AS u, dst AS v FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM sym WHERE src <> dst) WHERE r = 1) x JOIN (SELECT src AS u, dst AS v FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM sym WHERE src <> dst) WHERE r = 1) y ON x.u = y.v AND x.v = y.u WHERE x.u < x.v")(
    lambda s, d: cm.heavy_edge_matching(tb.nation_trade(s, d))
)
query("quantize_weights", "edges", "SELECT src, dst, round_even(w * 1000 / max(w) OVER (), 0)::BIGINT AS w FROM edges")(lambda s, d: cm.quantize(tb.nation_trade(s, d), 1000).select("src", "dst", "w"))


def _refined(name: str, swaps: bool, k: int | None, sizes: tuple[int, int]):
    small = {"vfd": (4, 2, 2), "vfd_moves": (3, 2, 4), "modular_vfd": (None, 2, 4), "balanced_kway": (2, 4, 4)}[name]

    @query(name, "", _best_sql(_MODULARITY, "links", small[1], small[2], small[0], more="0::BIGINT AS violations, 0::BIGINT AS worse, "))
    def run(s, d):
        g = Graph(tb.nation_trade(s, d))
        b = ke.score_matrix(g.a)
        rules = _rules(len(b), *sizes)
        start = ke.construct(rules, k or 5, 0)[rules.block]
        found = ke.balanced(b, rules, k, 0, 80, swaps)
        out = _report(s, violations=_broken(rules, found), worse=ke.score(b, found) < ke.score(b, start) - 1e-9)
        tight = ke.Rules(8, EIGHT_MUST, EIGHT_CANNOT, *small[1:])
        return _with_optimum(out, by_modularity(s, d, lambda a, b: ke.balanced(b, tight, small[0], 0, 120, swaps)))


for _n, _w, _k, _z in (("vfd", True, 5, (5, 5)), ("vfd_moves", False, 4, (4, 9)), ("modular_vfd", True, None, (2, 12)), ("balanced_kway", True, 4, (6, 7))):
    _refined(_n, _w, _k, _z)

# ------------------------------------------------------------------ core and periphery

query("find_core", "edges nodes", "SELECT CASE WHEN a > b THEN 0 ELSE 1 END AS core_is FROM (SELECT corr(coalesce(w, 0), ((x.node < 6) OR (y.node < 6))::INT) AS b, corr(coalesce(w, 0), ((x.node >= 6) OR (y.node >= 6))::INT) AS a FROM nodes x JOIN nodes y ON x.node < y.node LEFT JOIN edges ON src = x.node AND dst = y.node)")(
    lambda s, d: cm.find_core(tb.nation_trade(s, d), tb.nation_nodes(s, d).select("node", (F.col("node") < 6).cast("int").alias("c")))
)
query("find_core_advanced", "edges mem", "SELECT label, round(max(s), 9) + 0.0 AS score FROM (SELECT l.community AS label, corr(coalesce(w, 0), ((a.community <> l.community) OR (b.community <> l.community))::INT) AS s FROM (SELECT DISTINCT community FROM mem) l, mem a JOIN mem b ON a.node < b.node LEFT JOIN edges ON src = a.node AND dst = b.node GROUP BY 1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")(
    lambda s, d: cm.find_core_advanced(tb.nation_trade(s, d), tb.regions(s, d)).withColumn("score", tidy(F.col("score")))
)
_IT = "SELECT node, x / max(x) OVER () AS x FROM (SELECT src AS node, sum(w * {0}.x) AS x FROM sym JOIN {0} ON dst = {0}.node GROUP BY 1)"
SQL["cp_spectral_iter5"] = with_("sym", "").rstrip() + ", x0 AS (SELECT DISTINCT src AS node, 1.0::DOUBLE AS x FROM sym), " + ", ".join(f"x{i + 1} AS ({_IT.format(f'x{i}')})" for i in range(5)) + " SELECT node, round(x, 9) + 0.0 AS x FROM x5"
query("cp_spectral_iter5")(lambda s, d: cm.power_iteration(tb.nation_trade(s, d), 5).withColumn("x", tidy(F.col("x"))))


def _cp(name: str, algorithm: str):
    @query(name, "", "SELECT 0::BIGINT AS mismatches, 0::BIGINT AS uneven_blocks, 0::BIGINT AS outside")
    def run(s, d):
        e = tb.nation_trade(s, d)
        g, c, block = wf.coreness(s, e, ((0, 1),), (5, 6, 7), algorithm, seeds=2)
        again = me.be_score(e, s.createDataFrame([(int(x), float(v)) for x, v in zip(g.nodes, c, strict=True)], "node bigint, c double"), False).first()["score"]
        uneven = sum(len(set(np.round(c[block == k], 9))) > 1 for k in range(block.max() + 1))
        fit = ke.coreness_fit(g.a, c)
        return _report(s, mismatches=abs(again - fit) > 1e-6, uneven_blocks=uneven, outside=int(((c < -1e-9) | (c > 1 + 1e-9)).sum()))


for _n, _a in (("cp_spectral", "spectral"), ("cp_ga", "genetic"), ("cp_ga_binary", "genetic_binary"), ("cp_de", "differential"), ("cp_kl", "coordinate")):
    _cp(_n, _a)


@query("detect_core", "", "SELECT 25::BIGINT AS nodes, 0::BIGINT AS split_blocks")
def _detect_core(s, d):
    g, c, block = wf.coreness(s, tb.nation_trade(s, d), ((0, 1),), (5, 6, 7))
    mask = wf.split_core(g.a, c, 0.8, "gaussian_mixture")
    return _report(s, nodes=len(mask), split_blocks=sum(len(set(mask[block == k])) > 1 for k in range(block.max() + 1)))


@query("core_periphery_partition", "", "SELECT 25::BIGINT AS nodes, 0::BIGINT AS cut_edges, 0::BIGINT AS split_pairs")
def _core_periphery(s, d):
    e = strong_edges(s, d)
    found = wf.core_periphery(s, e, ((0, 1),), (5, 6, 7), nodes=tb.nation_nodes(s, d))
    a, b = found.select(F.col("node").alias("src"), F.col("community").alias("x")), found.select(F.col("node").alias("dst"), F.col("community").alias("y"))
    cut = e.join(a, "src").join(b, "dst").filter("x <> 0 and y <> 0 and x <> y").count()
    label = {r["node"]: r["community"] for r in found.collect()}
    return _report(s, nodes=len(label), cut_edges=cut, split_pairs=(label[0] != label[1]) + (len({label[5], label[6], label[7]}) > 1))


# ------------------------------------------------------------------ loops and workflows


@query("cg_run", "", _best_sql(_MODULARITY, "links", more="0::BIGINT AS violations, 0::BIGINT AS worse_than_one_block, 0::BIGINT AS wrong_scores, "))
def _cg(s, d):
    e = tb.nation_trade(s, d)
    out = decompose(s, e, Config(must=MUST, cannot=CANNOT, algorithm="multistart", trials=2, max_iterations=4))
    again = me.modularity(e, s.createDataFrame([(int(x), int(c)) for x, c in zip(out.metadata["nodes"], out.partition, strict=True)], "node bigint, community bigint")).first()["modularity"]
    return _report(s, violations=_broken(_rules(25), out.partition), worse_than_one_block=out.value < -1e-1, wrong_scores=abs(again - out.value) > 1e-9).withColumn("optimum", F.lit(_small_run(s, d)))


def _small_run(s, d) -> float:
    """Column generation on eight nations with links."""
    small, _ = eight(s, d)
    out = decompose(s, small, Config(must=EIGHT_MUST, cannot=EIGHT_CANNOT, algorithm="multistart", trials=4, max_iterations=8))
    return by_modularity(s, d, lambda a, b: out.partition)


@query("cg_records")
def _cg_records(s, d):
    out = decompose(s, tb.nation_trade(s, d), Config(algorithm="louvain", trials=2, max_iterations=3))
    return s.createDataFrame([(r.iteration, float(r.master_value), float(r.reduced_cost), int(r.column.max() + 1)) for r in out.records], "iteration int, master_value double, reduced_cost double, communities int")


@query("load_balance", "", _best_sql(_MODULARITY, "links", 4, 4, 2, more="5::BIGINT AS smallest, 5::BIGINT AS largest, 0::BIGINT AS violations, "))
def _load_balance(s, d):
    out = wf.load_balance(s, tb.nation_trade(s, d), 5, 0, must=MUST, cannot=CANNOT, max_iterations=2)
    size = np.bincount(out.partition)
    small = wf.load_balance(s, eight(s, d)[0], 2, 0, must=EIGHT_MUST, cannot=EIGHT_CANNOT, max_iterations=2)
    report = _report(s, smallest=size.min(), largest=size.max(), violations=_broken(_rules(25, 5, 5), out.partition))
    return _with_optimum(report, by_modularity(s, d, lambda a, b: small.partition))


@query("nonlinear_bp", "", "SELECT 25::BIGINT AS nodes, 0::BIGINT AS split")
def _nonlinear(s, d):
    e = tb.nation_trade(s, d)
    worthy = [(r["src"], r["dst"]) for r in e.collect() if (r["src"] + r["dst"]) % 6]
    out, refined = wf.nonlinear_partition(s, e, worthy, max_iterations=2)
    at = {x: c for x, c in zip(out.metadata["nodes"], out.partition, strict=True)}
    return _report(s, nodes=refined.count(), split=sum(at[r["src"]] != at[r["dst"]] for r in e.collect() if (r["src"] + r["dst"]) % 6 == 0))


@query("evaluation_report")
def _evaluation(s, d):
    rows = cs.capacity_planning(s, *plan_sizes(s, d, "region"))
    e = cs.constraint_graph(rows, CP).select("src", "dst", F.col("weight").cast("double").alias("w"))
    truth = rows.select(F.col("constraint").alias("node"), F.when(F.col("tag").isin("L", "CU"), 0).otherwise(1).cast("long").alias("community"))
    return wf.evaluate(s, e, truth, ("spectral",))


SQL["prob_dbscan"] = with_("soft", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """, q AS (SELECT node, sum(share * share) AS q FROM soft GROUP BY 1),
d AS (SELECT a.node AS u, b.node AS v, sum(a.share * b.share) AS dot FROM soft a JOIN soft b ON a.community = b.community GROUP BY 1, 2),
near AS (SELECT u, v FROM d JOIN q x ON x.node = u JOIN q y ON y.node = v WHERE x.q + y.q - 2 * dot <= 0.02 * 0.02 + 1e-12),
core AS (SELECT u FROM near GROUP BY 1 HAVING count(*) >= 3),
e AS (SELECT near.u, v FROM near JOIN core ON core.u = near.u JOIN core c2 ON c2.u = near.v),
r AS (SELECT u AS node, u AS reach FROM core UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach),
c AS (SELECT node, min(reach) AS c FROM r GROUP BY 1),
f AS (SELECT q.node, coalesce((SELECT min(c.c) FROM near JOIN c ON c.node = near.v WHERE near.u = q.node), -1) AS c FROM q),
rare AS (SELECT c AS r FROM f GROUP BY 1 ORDER BY count(*), c LIMIT 1)
SELECT node, CASE WHEN c = r OR c < 0 THEN -1 ELSE c END::BIGINT AS label FROM f, rare"""
query("prob_dbscan")(lambda s, d: de.label_by_cluster(QUERIES["soft_membership"](s, d), 0.02, 3))
query("prob_gmm")(lambda s, d: cm.label_by_mixture(QUERIES["soft_membership"](s, d)))
_SL = """SELECT CASE WHEN w > q THEN 0 ELSE 1 END AS layer, src, dst, abs(w - q) AS w FROM sym, med WHERE w <> q"""
SQL["signed_gain"] = with_("sym med mem", "").rstrip() + f""", s AS ({_SL}), k AS (SELECT layer, src AS node, sum(w) AS k FROM s GROUP BY 1, 2), l AS (SELECT layer, sum(k) AS l2 FROM k GROUP BY 1),
t AS (SELECT layer, community, sum(k) AS deg FROM k JOIN mem USING (node) GROUP BY 1, 2), i AS (SELECT layer, src AS node, community, sum(w) AS kic FROM s JOIN mem ON dst = mem.node GROUP BY 1, 2, 3),
v AS (SELECT h.node, h.community AS home, t.community, sum((CASE t.layer WHEN 0 THEN 1 ELSE -1 END) * (coalesce(kic, 0) - (deg - CASE WHEN t.community = h.community THEN k ELSE 0 END) * k / l2)) AS worth
 FROM mem h JOIN k ON k.node = h.node JOIN l USING (layer) JOIN t USING (layer) LEFT JOIN i ON i.layer = t.layer AND i.node = h.node AND i.community = t.community GROUP BY 1, 2, 3)
SELECT a.node, a.community AS "to", round(a.worth - b.worth, 6) + 0.0 AS gain FROM v a JOIN v b ON a.node = b.node AND b.community = b.home WHERE a.community <> a.home AND EXISTS (SELECT 1 FROM i z WHERE z.node = a.node AND z.community = a.community)"""
query("signed_gain")(lambda s, d: me.signed_move_gains(QUERIES["signed_layers"](s, d), tb.regions(s, d), {0: 1.0, 1: -1.0}).withColumn("gain", tidy(F.col("gain"), 6)))


SQL["contract_worthy"] = with_("edges nodes", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """, x AS (SELECT src AS u, dst AS v FROM edges WHERE (src + dst) % 23 = 0),
y AS (SELECT u, v FROM x UNION ALL SELECT v, u FROM x), r AS (SELECT node, node AS reach FROM nodes UNION SELECT r.node, y.v FROM r JOIN y ON r.reach = y.u),
c AS (SELECT node, dense_rank() OVER (ORDER BY m) - 1 AS comp FROM (SELECT node, min(reach) AS m FROM r GROUP BY 1))
SELECT least(a.comp, b.comp) AS src, greatest(a.comp, b.comp) AS dst, sum(CASE WHEN a.comp = b.comp THEN 2 * w ELSE w END) AS w FROM edges JOIN c a ON src = a.node JOIN c b ON dst = b.node GROUP BY 1, 2"""


@query("contract_worthy")
def _contract_by_worth(s, d):
    e = tb.nation_trade(s, d)
    worthy = e.filter("(src + dst) % 23 <> 0").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    links = co.unworthy_edges(e, worthy).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return co.contract_graph(e, co.link_components(tb.nation_nodes(s, d), links)).select(F.col("src").cast("long"), F.col("dst").cast("long"), "w")
