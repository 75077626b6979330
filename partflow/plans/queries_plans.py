"""Queries over searches that are plans from end to end: no graph is collected, whatever its size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partflow.functions import metrics as me
from partflow.functions.metrics import tidy
from partflow.functions.storage import cut, sent
from partflow.operators import community as cm
from partflow.operators import ensemble as en
from partflow.operators import lanczos as la
from partflow.operators import louvain as lo
from partflow.operators import multilevel as ml
from partflow.operators import paths as pa
from partflow.sources import graphs as gr
from partflow.sources import tables as tb

from . import queries_search  # noqa: F401 - its queries come first
from .queries import CTE, QUERIES, SQL, node_duals, pair_duals, pool, query, strong_edges, with_  # noqa: F401

CTE["sup"] = "SELECT a.l_suppkey::BIGINT AS src, b.l_suppkey::BIGINT AS dst, count(*)::DOUBLE AS w FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY 1, 2"
CTE["supnodes"] = "SELECT s_suppkey::BIGINT AS node FROM supplier"


def met(s: SparkSession, d: str) -> DataFrame:
    """The supplier graph, stored: what reads it several times makes it once."""
    return cut(tb.supplier_orders(s, d), "sup")


def suppliers(s: SparkSession, d: str) -> DataFrame:
    return tb.table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("node"))


# ------------------------------------------------------------------ Louvain


def _start_sql(edges: str, nodes: str, duals: str | None = None, pairs: str | None = None) -> str:
    """The state and arcs that a search starts with, as CTEs x0 and arcs."""
    priced = f" UNION ALL SELECT u, v, -value / 2 FROM {pairs} UNION ALL SELECT v, u, -value / 2 FROM {pairs}" if pairs else ""
    value = f"coalesce((SELECT value FROM {duals} z WHERE z.node = n.node), 0)" if duals else "0.0"
    return f"""lsym AS MATERIALIZED (SELECT src, dst, w FROM {edges} UNION ALL SELECT dst, src, w FROM {edges}),
lvol AS (SELECT sum(w) AS m FROM lsym),
arcs AS MATERIALIZED (SELECT src, dst, sum(e) AS e FROM (SELECT src, dst, w / m AS e FROM lsym, lvol{priced}) GROUP BY 1, 2),
x0 AS MATERIALIZED (SELECT n.node, coalesce((SELECT sum(w) FROM lsym WHERE src = n.node) / m, 0) AS a, 1 AS size, {value}::DOUBLE AS dual, n.node AS community FROM {nodes} n, lvol)"""


def _round_sql(k: int, seed: int) -> str:
    """Round k as CTEs: state x{k} from x{k - 1}."""
    x = f"x{k - 1}"
    return f"""sums{k} AS (SELECT community, sum(a) AS t, sum(size) AS n, sum(dual) AS d FROM {x} GROUP BY 1),
links{k} AS MATERIALIZED (SELECT src AS node, community AS "to", sum(e) AS e FROM arcs JOIN {x} ON dst = node GROUP BY 1, 2),
gains{k} AS (SELECT i.node, i.community, l."to", round(2 * (l.e - coalesce(o.e, 0)) - 2 * i.a * (b.t - c.t + i.a) - i.dual * (b.n - c.n + i.size) - i.size * (b.d - c.d + i.dual), 12) AS gain
  FROM links{k} l JOIN {x} i USING (node) JOIN sums{k} b ON b.community = l."to" JOIN sums{k} c ON c.community = i.community LEFT JOIN links{k} o ON o.node = i.node AND o."to" = i.community WHERE l."to" <> i.community),
moves{k} AS MATERIALIZED (SELECT *, (node * 7919 + {seed * 104729}) % 1000003 AS priority FROM gains{k} WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, "to") = 1),
best{k} AS (SELECT node FROM (SELECT node, gain, priority, community AS touched FROM moves{k} UNION ALL SELECT node, gain, priority, "to" FROM moves{k}) QUALIFY row_number() OVER (PARTITION BY touched ORDER BY gain DESC, priority DESC, node DESC) = 1),
won{k} AS (SELECT node FROM best{k} GROUP BY 1 HAVING count(*) = 2),
x{k} AS MATERIALIZED (SELECT i.node, i.a, i.size, i.dual, CASE WHEN w.node IS NULL THEN i.community ELSE m."to" END AS community FROM {x} i LEFT JOIN won{k} w USING (node) LEFT JOIN moves{k} m USING (node))"""


def _two_rounds(edges: DataFrame, nodes: DataFrame, **duals) -> DataFrame:
    state, arcs = lo.start(edges, nodes, **duals)
    for seed in (0, 1):
        state = cut(lo.local_round(state, arcs, seed), "level")
    return state.select("node", "community")


_TWO = _round_sql(1, 0) + ",\n" + _round_sql(2, 1) + "\nSELECT node, community FROM x2"
SQL["louvain_round2"] = with_("sup supnodes", "").rstrip() + ", " + _start_sql("sup", "supnodes") + ",\n" + _TWO
query("louvain_round2")(lambda s, d: _two_rounds(met(s, d), suppliers(s, d)))
SQL["louvain_dual_round2"] = with_("edges nodes ndual pdual", "").rstrip() + ", " + _start_sql("edges", "nodes", "ndual", "pdual") + ",\n" + _TWO
query("louvain_dual_round2")(lambda s, d: _two_rounds(tb.nation_trade(s, d), tb.nation_nodes(s, d), node_duals=node_duals(s, d), pair_duals=pair_duals(s, d)))


@query("louvain_plan")
def _louvain_plan(s: SparkSession, d: str) -> DataFrame:
    """(node, community) of the whole supplier graph."""
    return lo.louvain(met(s, d), suppliers(s, d))[0]


@query("louvain_levels")
def _louvain_levels(s: SparkSession, d: str) -> DataFrame:
    """(level, communities, modularity) of the supplier graph: the score never falls."""
    e = met(s, d)
    out = None
    for k, membership in enumerate(lo.louvain(e, suppliers(s, d))[1], 1):
        row = me.modularity(e, membership).crossJoin(membership.agg(F.countDistinct("community").alias("communities"))).select(F.lit(k).alias("level"), "communities", tidy(F.col("modularity")).alias("modularity"))
        out = row if out is None else out.unionByName(row)
    return out


@query("louvain_dual_plan")
def _louvain_dual_plan(s: SparkSession, d: str) -> DataFrame:
    """(node, community) of the nation graph under node and pair duals."""
    return lo.louvain(tb.nation_trade(s, d), tb.nation_nodes(s, d), node_duals=node_duals(s, d), pair_duals=pair_duals(s, d))[0]


# ------------------------------------------------------------------ paths

query("edge_betweenness")(lambda s, d: pa.edge_betweenness(strong_edges(s, d)).withColumn("betweenness", tidy(F.col("betweenness"), 6)))

_Y = """y AS MATERIALIZED (SELECT src, dst, w FROM strong UNION ALL SELECT dst, src, w FROM strong), k AS (SELECT src AS node, count(*) AS k, sum(w) AS a FROM y GROUP BY 1),
len AS MATERIALIZED (SELECT s.src, s.dst, round((least(x.k, z.k) - 1) / ((SELECT count(*) FROM y p JOIN y q ON p.dst = q.dst WHERE p.src = s.src AND q.src = s.dst) + 1)::DOUBLE, 9) AS length
  FROM strong s JOIN k x ON x.node = s.src JOIN k z ON z.node = s.dst),
around AS (SELECT node, node AS v FROM k UNION SELECT src, dst FROM y),
dens AS MATERIALIZED (SELECT k.node, round((SELECT sum(y.w) FROM y JOIN around p ON p.v = y.src AND p.node = k.node JOIN around q ON q.v = y.dst AND q.node = k.node)
  / (SELECT sum(z.a) FROM around p JOIN k z ON z.node = p.v WHERE p.node = k.node) * k.a, 9) AS density FROM k),
d0 AS (SELECT src AS u, dst AS v, length AS d FROM len UNION ALL SELECT dst, src, length FROM len UNION ALL SELECT node, node, 0 FROM k)"""
for _k in range(1, 6):  # doubling: paths of up to 32 edges
    _Y += f",\nd{_k} AS MATERIALIZED (SELECT p.u, q.v, round(min(p.d + q.d), 9) AS d FROM d{_k - 1} p JOIN d{_k - 1} q ON p.v = q.u GROUP BY 1, 2)"
_SEEDS = _Y + """,
near AS (SELECT u, list(v) AS vs FROM d5 WHERE d <= 2.0 AND u <> v GROUP BY 1),
ord AS (SELECT row_number() OVER (ORDER BY density DESC, dens.node) AS pos, dens.node, coalesce(vs, []) AS vs FROM dens LEFT JOIN near ON u = dens.node),
walk AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS seeds UNION ALL SELECT o.pos, CASE WHEN list_has_any(seeds, o.vs) THEN seeds ELSE list_append(seeds, o.node) END FROM walk w JOIN ord o ON o.pos = w.pos + 1),
chosen AS (SELECT unnest(seeds) AS node FROM (SELECT seeds FROM walk ORDER BY pos DESC LIMIT 1))"""
RADIUS = 2.0


def _recursive(needs: str, body: str) -> str:
    return with_(needs, "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ", " + body


SQL["edge_lengths"] = _recursive("strong", _Y + "\nSELECT src, dst, length FROM len")
query("edge_lengths")(lambda s, d: pa.edge_lengths(strong_edges(s, d)))
SQL["local_density"] = _recursive("strong", _Y + "\nSELECT node, density FROM dens")
query("local_density")(lambda s, d: pa.local_density(strong_edges(s, d)))
SQL["voronoi_seeds"] = _recursive("strong", _SEEDS + "\nSELECT node FROM chosen")
query("voronoi_seeds")(lambda s, d: pa.spread_seeds(pa.local_density(strong_edges(s, d)).select("node", F.col("density").alias("rank")), pa.balls(pa.edge_lengths(strong_edges(s, d)), RADIUS)))
SQL["voronoi"] = _recursive("strong nodes", _SEEDS + """
SELECT n.node, coalesce((SELECT c.node FROM chosen c JOIN d5 ON u = c.node AND v = n.node ORDER BY d, c.node LIMIT 1), n.node) AS community FROM nodes n""")
query("voronoi")(lambda s, d: pa.voronoi(strong_edges(s, d), tb.nation_nodes(s, d), RADIUS))
SQL["triangles"] = with_("strong", "SELECT a.src AS u, a.dst AS v, b.dst AS z FROM strong a JOIN strong b ON a.dst = b.src JOIN strong c ON c.src = a.src AND c.dst = b.dst")
query("triangles")(lambda s, d: pa.triangles(strong_edges(s, d)).select(F.sort_array(F.array("a", "b", "c")).alias("x")).select(F.col("x")[0].alias("u"), F.col("x")[1].alias("v"), F.col("x")[2].alias("z")))
SQL["walktrap_merges"] = with_("strong", "").rstrip() + """, y AS MATERIALIZED (SELECT src, dst, w FROM strong UNION ALL SELECT dst, src, w FROM strong), k AS (SELECT src AS node, sum(w) AS a FROM y GROUP BY 1),
step AS MATERIALIZED (SELECT src, dst, w / a AS p FROM y JOIN k ON node = src),
two AS MATERIALIZED (SELECT x.src, z.dst, sum(x.p * z.p) AS p FROM step x JOIN step z ON x.dst = z.src GROUP BY 1, 2),
four AS MATERIALIZED (SELECT x.src, z.dst, sum(x.p * z.p) AS p FROM two x JOIN two z ON x.dst = z.src GROUP BY 1, 2),
row AS MATERIALIZED (SELECT i.node AS c, j.node AS v, coalesce(p, 0) / sqrt(j.a) AS x FROM k i CROSS JOIN k j LEFT JOIN four ON src = i.node AND dst = j.node),
ward AS MATERIALIZED (SELECT s.src AS u, s.dst AS v, round(0.5 * sum((p.x - q.x) * (p.x - q.x)), 9) AS d FROM strong s JOIN row p ON p.c = s.src JOIN row q ON q.c = s.dst AND q.v = p.v GROUP BY 1, 2),
least AS (SELECT u, v FROM (SELECT u, v, d, u AS c FROM ward UNION ALL SELECT u, v, d, v FROM ward) QUALIFY row_number() OVER (PARTITION BY c ORDER BY d, u, v) = 1)
SELECT u, v FROM least GROUP BY 1, 2 HAVING count(*) = 2"""


@query("walktrap_merges")
def _walktrap_merges(s: SparkSession, d: str) -> DataFrame:
    """The first merges of walktrap on the strong nation graph: (u, v) with v joined to u."""
    first = pa.walktrap(strong_edges(s, d), tb.nation_nodes(s, d), rounds=1)[1][0]
    return first.filter("node <> community").select(F.col("community").alias("u"), F.col("node").alias("v"))


@query("walktrap")
def _walktrap(s: SparkSession, d: str) -> DataFrame:
    """(node, community): of the rounds of walktrap the partition of highest modularity."""
    e = cut(strong_edges(s, d), "strong")
    _, levels = pa.walktrap(e, tb.nation_nodes(s, d), relative=True)
    return max(levels, key=lambda x: me.modularity(e, x).first()[0])


# ------------------------------------------------------------------ ensembles


def _ensemble(s: SparkSession, d: str) -> DataFrame:
    e = cut(strong_edges(s, d), "strong")
    return en.memberships(e.withColumn("w", F.col("w") / 100), tb.nation_nodes(s, d).select("node"), (3, 5), (1, 2))


@query("ensemble_members")
def _ensemble_members(s: SparkSession, d: str) -> DataFrame:
    """(run, method, k, seed, node, community) of clusterings of the nation graph."""
    return _ensemble(s, d)


@query("ensemble_coassociation")
def _ensemble_coassociation(s: SparkSession, d: str) -> DataFrame:
    """(i, j, share) of the trading pairs: how often the ensemble puts both into one cluster."""
    return en.pair_shares(_ensemble(s, d), tb.nation_trade(s, d).select(F.col("src").alias("u"), F.col("dst").alias("v"))).withColumn("share", tidy(F.col("share")))


MOST = 4
_WEIGHTED = "SELECT part_id, node, community, CASE part_id WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.1 END::DOUBLE AS weight FROM pool"
SQL["fractional_blocks"] = _recursive("pool strong mem", f"""
wp AS ({_WEIGHTED}),
z AS (SELECT x.node AS i, y.node AS j, CASE WHEN x.node = y.node THEN 1 ELSE round_even(round(sum(x.weight), 12), 0) END AS z FROM wp x JOIN wp y USING (part_id, community) GROUP BY 1, 2),
rows AS (SELECT i AS node, string_agg(j || ':' || z, ',' ORDER BY j) AS row FROM z WHERE z <> 0 GROUP BY 1),
ids AS (SELECT node, row, 1 + node % 3 AS size, row_number() OVER (ORDER BY node) AS pos FROM rows),
apart AS (SELECT src AS u, dst AS v FROM strong UNION SELECT dst, src FROM strong),
conf AS (SELECT a.node, a.pos, a.row, a.size, list(b.pos) FILTER (b.pos IS NOT NULL) AS before FROM ids a LEFT JOIN (SELECT b.pos, b.row, u, v FROM ids b JOIN apart ON u = b.node) b ON b.v = a.node AND b.row = a.row AND b.pos < a.pos GROUP BY 1, 2, 3, 4),
paint AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS colors UNION ALL
  SELECT c.pos, list_append(colors, list_min([k FOR k IN range(0, 30) IF NOT list_contains([colors[p] FOR p IN coalesce(before, [])], k)])) FROM paint r JOIN conf c ON c.pos = r.pos + 1),
shade AS (SELECT node, row, size, (SELECT colors FROM paint ORDER BY pos DESC LIMIT 1)[c.pos] AS color FROM conf c),
turn AS (SELECT *, row_number() OVER (PARTITION BY row, color ORDER BY size DESC, node) AS place FROM shade),
fill AS (SELECT row, color, place, node, 0 AS part, size AS held FROM turn WHERE place = 1 UNION ALL
  SELECT t.row, t.color, t.place, t.node, CASE WHEN f.held + t.size > {MOST} THEN f.part + 1 ELSE f.part END, CASE WHEN f.held + t.size > {MOST} THEN t.size ELSE f.held + t.size END
  FROM fill f JOIN turn t ON t.row = f.row AND t.color = f.color AND t.place = f.place + 1)
SELECT node, min(node) OVER (PARTITION BY row, color, part) AS block FROM fill""")


@query("fractional_blocks")
def _fractional_blocks(s: SparkSession, d: str) -> DataFrame:
    """(node, block): nations with identical rounded rows of a weighted pool, trading pairs apart, MOST in size at most."""
    weights = s.createDataFrame([(1, 0.6), (2, 0.3), (3, 0.1)], "part_id int, weight double")
    sizes = tb.nation_nodes(s, d).select("node", (1 + F.col("node") % 3).alias("size"))
    return en.blocks(pool(s, d), weights, sizes, strong_edges(s, d).select(F.col("src").alias("u"), F.col("dst").alias("v")), MOST, 0)


# ------------------------------------------------------------------ integer weights

query("quantize_integers", "edges", "SELECT src, dst, w::BIGINT AS w, 1.0::DOUBLE AS scale FROM edges")(lambda s, d: _integers(tb.nation_trade(s, d)))
query("quantize_fractions", "edges", "SELECT src, dst, round_even(w / 8 * q, 0)::BIGINT AS w, q AS scale FROM edges, (SELECT 1.0::DOUBLE / (1e-7::DOUBLE * max(w / 8)) AS q FROM edges)")(
    lambda s, d: _integers(tb.nation_trade(s, d).withColumn("w", F.col("w") / 8))
)
query("quantize_total", "edges", "SELECT src, dst, round_even(w * 1000 * q, 0)::BIGINT AS w, q AS scale FROM edges, (SELECT sum(w) * 1000 // 4 * 4 / (2 * sum(w * 1000)) AS q FROM edges)")(lambda s, d: _under_half(s, d))


def _integers(edges: DataFrame, **how) -> DataFrame:
    out, scale = cm.integer_weights(edges, **how)
    return out.withColumn("scale", F.lit(scale))


def _under_half(s: SparkSession, d: str) -> DataFrame:
    """Weights beyond a total of about half of theirs are scaled down to it."""
    e = tb.nation_trade(s, d).withColumn("w", F.col("w") * 1000)
    total = int(e.agg(F.sum("w")).first()[0] // 4 * 4)
    return _integers(e, resolution=1e-9, total=total)


# ------------------------------------------------------------------ balanced parts of the supplier graph

PARTS = 3


@query("multilevel_kway", "sup supnodes", f"SELECT {PARTS}::BIGINT AS parts, count(*) AS nodes, true AS in_bounds, true AS better_than_chunks FROM supnodes")
def _multilevel(s: SparkSession, d: str) -> DataFrame:
    """How many parts and nodes the partition of the supplier graph has, whether every part is as even as can be, and whether it scores at least what
    cutting the nodes' order into chunks does."""
    e, nodes = met(s, d), suppliers(s, d)
    n = nodes.count()
    found = ml.balanced_kway(e, nodes, PARTS, n // PARTS, -(-n // PARTS))
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("nodes"), ((F.min("n") >= n // PARTS) & (F.max("n") <= -(-n // PARTS))).alias("in_bounds"))
    mine, chunks = (me.modularity(e, x).first()[0] for x in (found, cm.balanced_chunks(nodes.select("node", F.col("node").alias("pos")), PARTS)))
    return row.withColumn("better_than_chunks", F.lit(bool(mine >= chunks)))


# ------------------------------------------------------------------ orders

query("fiedler_order")(lambda s, d: la.fiedler_order(strong_edges(s, d), tb.nation_nodes(s, d)))


@query("fiedler_residual", "supnodes", "SELECT count(*) AS nodes, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS length, true AS solved FROM supnodes")
def _fiedler_residual(s: SparkSession, d: str) -> DataFrame:
    """Of the supplier graph's second eigenvector: nodes, mean, length, and whether L x - lambda x is below 1e-8 of the largest degree, by a plan."""
    e, nodes = met(s, d), suppliers(s, d)
    x, value, _ = la.fiedler_vector(e, nodes, 1e-10)
    arcs = gr.both_ways(e)
    across = arcs.join(sent(x.select(F.col("node").alias("dst"), F.col("x").alias("y")), x.count()), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("deg"), F.sum(F.col("w") * F.col("y")).alias("across"))
    z = F.lit(0.0)
    rest = F.coalesce("deg", z) * F.col("x") - F.coalesce("across", z) - F.lit(value) * F.col("x")
    rows = x.join(across, "node", "left")
    return rows.agg(F.count(F.lit(1)).alias("nodes"), tidy(F.avg("x"), 6).alias("mean"), tidy(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("length"), (F.sqrt(F.sum(rest * rest)) <= 1e-8 * F.greatest(F.lit(1.0), F.max("deg"))).alias("solved"))
