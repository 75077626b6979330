"""Queries over beams of partial assignments, orbits, density labels and compound moves: plans over the given tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partflow.functions import metrics as me
from partflow.functions.metrics import tidy
from partflow.functions.storage import cut
from partflow.operators import beam as be
from partflow.operators import contract as co
from partflow.operators import density as de
from partflow.operators import louvain as lo
from partflow.operators import multilevel as ml
from partflow.operators import symmetry as sy
from partflow.sources import tables as tb

from . import queries_plans  # noqa: F401 - its queries come first
from .queries import QUERIES, SQL, cannot_links, nation_components, query, with_

# ------------------------------------------------------------------ beams

PARTS, LOW, HIGH, WIDTH, BRANCH, NOISE = 4, 5, 8, 8, 6, 5
STEPS = 23  # blocks of the nations: 25 less two must-links


def block_orders(s: SparkSession, d: str) -> DataFrame:
    """(run, seed, node, pos): blocks by number and by the region of their first nation, each with two seeds."""
    first = nation_components(s, d).groupBy("comp").agg(F.min("node").alias("node")).join(tb.regions(s, d), "node")
    rows = first.select(F.col("comp").alias("node"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("comp").cast("long").alias("pos")), F.struct(F.lit(1).alias("kind"), (F.col("community") * 1000 + F.col("comp")).alias("pos")))).alias("o"))
    return rows.select("node", "o.kind", "o.pos", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("seed")).select((F.col("kind") * 2 + F.col("seed")).alias("run"), F.col("seed").cast("long").alias("seed"), "node", "pos")


def _columns(s: SparkSession, d: str) -> DataFrame:
    comp = cut(nation_components(s, d), "comp")
    conflicts = co.contract_pairs(cannot_links(s), comp)
    return be.columns(block_orders(s, d), comp.select("node", F.col("comp").alias("block")), conflicts, PARTS, LOW, HIGH, WIDTH, BRANCH, NOISE)


_GS = f"(SELECT unnest(range(0, {PARTS})) AS g)"
_BEAM = """blk AS MATERIALIZED (SELECT comp AS node, count(*) AS size, min(node) AS head FROM comp GROUP BY 1),
ap AS (SELECT DISTINCT x.comp AS u, y.comp AS v FROM (SELECT u, v FROM cannot UNION ALL SELECT v, u FROM cannot) c JOIN comp x ON x.node = c.u JOIN comp y ON y.node = c.v),
ord AS (SELECT kind * 2 + seed AS run, seed, blk.node, size, CASE kind WHEN 0 THEN blk.node ELSE community * 1000 + blk.node END AS key FROM blk JOIN mem ON mem.node = head, (SELECT unnest([0, 1]) AS kind), (SELECT unnest([0, 1]) AS seed)),
pl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY key) - 1 AS pos, sum(size) OVER (PARTITION BY run) - sum(size) OVER (PARTITION BY run ORDER BY key) AS later FROM ord),
ln AS MATERIALIZED (SELECT p.*, coalesce((SELECT list(q.pos) FROM pl q JOIN ap ON ap.v = q.node WHERE q.run = p.run AND ap.u = p.node AND q.pos < p.pos), []) AS against FROM pl p),
b0 AS (SELECT DISTINCT run, 0::BIGINT AS cost, []::BIGINT[] AS labels, [0 FOR i IN range({k})]::BIGINT[] AS held, [0 FOR i IN range({k})]::BIGINT[] AS last FROM ln)"""
_EXTEND = """e{q} AS (SELECT b.run, b.cost, labels, g, held AS old, last, pos, seed, later, [CASE WHEN i = g THEN held[i + 1] + size ELSE held[i + 1] END FOR i IN range({k})]::BIGINT[] AS held, size
  FROM b{p} b JOIN ln ON ln.run = b.run AND ln.pos = {p} CROSS JOIN {gs} WHERE g <= len([x FOR x IN b.held IF x > 0]) AND b.held[g + 1] + size <= {high} AND NOT list_contains([labels[a + 1] FOR a IN against], g)),
f{q} AS (SELECT run, labels, g, held, [CASE WHEN i = g THEN pos ELSE last[i + 1] END FOR i IN range({k})]::BIGINT[] AS last, cost
  + {contiguity} * CASE WHEN old[g + 1] > 0 THEN pos - 1 - last[g + 1] ELSE 0 END + {switch} * CASE WHEN pos > 0 AND labels[len(labels)] <> g THEN 1 ELSE 0 END
  + {target} * (abs({k} * held[g + 1] - 25) - abs({k} * old[g + 1] - 25)) + ((pos * 7919 + g * 104729 + seed * 1299709) % 1000003) % ({noise} + 1) AS cost
  FROM e{q} WHERE list_sum([greatest({low} - x, 0) FOR x IN held]) <= later AND later <= list_sum([{high} - x FOR x IN held])),
w{q} AS (SELECT run, cost, list_append(labels, g) AS labels, held, last FROM f{q} QUALIFY row_number() OVER (PARTITION BY run, labels ORDER BY cost, g) <= {branch}),
b{q} AS MATERIALIZED (SELECT * FROM w{q} QUALIFY row_number() OVER (PARTITION BY run ORDER BY cost, labels) <= {width})"""
_VALUES = {"k": PARTS, "low": LOW, "high": HIGH, "width": WIDTH, "branch": BRANCH, "noise": NOISE, "gs": _GS, "contiguity": be.CONTIGUITY, "switch": be.SWITCH, "target": be.TARGET}
SQL["beam_columns"] = with_("comp mem cannot", "").rstrip() + ",\n" + ",\n".join([_BEAM.format(**_VALUES), *[_EXTEND.format(p=p, q=p + 1, **_VALUES) for p in range(STEPS)]]) + f""",
top AS (SELECT run, labels FROM b{STEPS} QUALIFY row_number() OVER (PARTITION BY run ORDER BY cost, labels) = 1),
giv AS MATERIALIZED (SELECT top.run, ln.node, labels[pos + 1] AS community FROM top JOIN ln USING (run)),
nam AS (SELECT run, node, min(node) OVER (PARTITION BY run, community) AS name FROM giv),
sig AS (SELECT run, string_agg(name, ',' ORDER BY node) AS sig FROM nam GROUP BY 1),
fst AS (SELECT min(run) AS run FROM sig GROUP BY sig)
SELECT run, c.node, community FROM giv JOIN fst USING (run) JOIN comp c ON c.comp = giv.node"""
query("beam_columns")(lambda s, d: _columns(s, d).select(F.col("run").cast("long"), "node", "community"))


@query("beam_quality", "nodes", "SELECT 0::BIGINT AS sizes, 0::BIGINT AS split, 0::BIGINT AS together, true AS better_than_round_robin FROM nodes LIMIT 1")
def _beam_quality(s: SparkSession, d: str) -> DataFrame:
    """Of the beam's columns: communities out of bounds, must-links cut, cannot-links inside, and whether the best scores at least what dealing does."""
    x, e = cut(_columns(s, d), "columns"), tb.nation_trade(s, d)
    sizes = x.groupBy("run", "community").agg(F.count(F.lit(1)).alias("n")).filter(f"n < {LOW} or n > {HIGH}").agg(F.count(F.lit(1)).alias("sizes"))
    split = x.groupBy("run", "block").agg(F.countDistinct("community").alias("k")).filter("k > 1").agg(F.count(F.lit(1)).alias("split"))
    a, b = x.select("run", F.col("node").alias("u"), F.col("community").alias("a")), x.select("run", F.col("node").alias("v"), F.col("community").alias("b"))
    together = cannot_links(s).join(a, "u").join(b, ["run", "v"]).filter("a = b").agg(F.count(F.lit(1)).alias("together"))
    best = max(me.modularity(e, x.filter(F.col("run") == r["run"]).select("node", "community")).first()[0] for r in x.select("run").distinct().collect())
    dealt = me.modularity(e, QUERIES["round_robin"](s, d)).first()[0]
    return sizes.crossJoin(split).crossJoin(together).withColumn("better_than_round_robin", F.lit(bool(best >= dealt)))


# ------------------------------------------------------------------ orbits

_TREE = """leaf AS (SELECT node, region, node % 3 AS color FROM nodes), hub AS (SELECT region, string_agg(color, ',' ORDER BY color) AS sig FROM leaf GROUP BY 1)
SELECT node, min(node) OVER (PARTITION BY color, sig) AS orbit FROM leaf JOIN hub USING (region) UNION ALL SELECT 100 + region, min(100 + region) OVER (PARTITION BY sig) FROM hub"""


def region_tree(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations hung on their regions (node 100 + region): edges, nodes, colors. A nation's color is its key modulo 3, a region's its own."""
    n = tb.regions(s, d)
    hubs = n.select((F.col("community") + 100).alias("node")).distinct()
    edges = n.select(F.col("node").alias("src"), (F.col("community") + 100).alias("dst"), F.lit(1.0).alias("w"))
    return edges, n.select("node").unionByName(hubs), n.select("node", F.pmod("node", F.lit(3)).cast("string").alias("color")).unionByName(hubs.withColumn("color", F.lit("hub")))


SQL["tree_orbits"] = with_("nodes", "").rstrip() + ", " + _TREE
query("tree_orbits")(lambda s, d: sy.orbits(*region_tree(s, d))[0])

query("orbits", "nodes", "SELECT node, min(node) OVER (PARTITION BY n) AS orbit FROM nodes JOIN (SELECT region, count(*) AS n FROM nodes GROUP BY 1) USING (region) UNION ALL SELECT 100 + region, min(100 + region) OVER (PARTITION BY n) FROM (SELECT region, count(*) AS n FROM nodes GROUP BY 1)")(
    lambda s, d: sy.orbits(*region_tree(s, d)[:2])[0]
)


@query("orbit_maps", "nodes", "SELECT 0::BIGINT AS broken_edges, 0::BIGINT AS not_onto, 0::BIGINT AS unproved FROM nodes LIMIT 1")
def _orbit_maps(s: SparkSession, d: str) -> DataFrame:
    """Of the maps that prove the orbits: edges that they break, maps that aren't one to one and onto, nodes that no map joins to their orbit."""
    edges, nodes, colors = region_tree(s, d)
    found, maps = sy.orbits(edges, nodes, colors)
    n = nodes.count()
    two = lambda a, b: F.concat_ws(":", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
    a, b = maps.select("map", F.col("node").alias("src"), F.col("image").alias("x")), maps.select("map", F.col("node").alias("dst"), F.col("image").alias("y"))
    image = edges.join(a, "src").join(b, ["map", "dst"]).select(two("x", "y").alias("e"))
    broken = image.join(edges.select(two("src", "dst").alias("e")), "e", "left_anti").agg(F.count(F.lit(1)).alias("broken_edges"))
    onto = maps.groupBy("map").agg(F.countDistinct("image").alias("k")).filter(F.col("k") != n).agg(F.count(F.lit(1)).alias("not_onto"))
    moved = maps.filter("node <> image").select(F.explode(F.array("node", "image")).alias("node")).distinct()
    bare = found.join(found.groupBy("orbit").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "orbit").join(moved, "node", "left_anti").agg(F.count(F.lit(1)).alias("unproved"))
    return broken.crossJoin(onto).crossJoin(bare)


# ------------------------------------------------------------------ density labels

_NEAR = """q AS (SELECT node, sum(share * share) AS q FROM {0} GROUP BY 1),
dd AS (SELECT a.node AS u, b.node AS v, sum(CASE WHEN a.community = b.community THEN a.share * b.share ELSE 0 END) AS dot FROM {0} a CROSS JOIN {0} b GROUP BY 1, 2),
near AS MATERIALIZED (SELECT u, v FROM dd JOIN q x ON x.node = u JOIN q y ON y.node = v WHERE x.q + y.q - 2 * dot <= {1} * {1} + 1e-12),
core AS (SELECT u FROM near GROUP BY 1 HAVING count(*) >= {2}),
e AS (SELECT near.u, v FROM near JOIN core ON core.u = near.u JOIN core c2 ON c2.u = near.v),
r AS (SELECT u AS node, u AS reach FROM core UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach),
c AS (SELECT node, min(reach) AS c FROM r GROUP BY 1),
f AS (SELECT q.node, coalesce((SELECT min(c.c) FROM near JOIN c ON c.node = near.v WHERE near.u = q.node), -1) AS c FROM q),
rare AS (SELECT c AS r FROM f GROUP BY 1 ORDER BY count(*), c LIMIT 1),
arg AS (SELECT node, community FROM soft QUALIFY row_number() OVER (PARTITION BY node ORDER BY share DESC, community) = 1)
SELECT node, CASE WHEN c = r THEN -1 ELSE community END::BIGINT AS label FROM f JOIN arg USING (node), rare"""
SQL["density_labels"] = with_("soft", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """, tops AS (SELECT node, max(share) AS p FROM soft GROUP BY 1), lim AS (SELECT min(p) AS a, max(p) AS b FROM tops), sd AS (SELECT stddev_pop(p) AS sd FROM (SELECT DISTINCT p FROM tops)),
fit AS MATERIALIZED (SELECT node, community, CASE WHEN sd < 0.25 THEN greatest((share - a) / (b - a + 1e-12), 0) ELSE share END AS share FROM soft, lim, sd),
""" + _NEAR.format("fit", 0.15, 2)
query("density_labels")(lambda s, d: de.label_by_density(QUERIES["soft_membership"](s, d), 0.15, 2))


# ------------------------------------------------------------------ compound moves

_CHAINS = """m AS (SELECT sum(w) AS m FROM sym), i AS (SELECT node, community AS c, a / m AS a FROM mem JOIN deg USING (node), m), ee AS MATERIALIZED (SELECT src, dst, w / m AS e FROM sym, m),
b AS MATERIALIZED (SELECT x.node AS u, y.node AS v, x.c AS cu, y.c AS cv, coalesce(e, 0) - x.a * y.a AS b FROM i x CROSS JOIN i y LEFT JOIN ee ON src = x.node AND dst = y.node),
g AS MATERIALIZED (SELECT u, cu, cv AS to, round(2 * sum(b) - 2 * (SELECT sum(z.b) FROM b z WHERE z.u = b.u AND z.cv = b.cu AND z.v <> b.u), 12) AS gain FROM b WHERE cu <> cv GROUP BY 1, 2, 3),
lk AS (SELECT DISTINCT src AS u, c AS to FROM ee JOIN i ON i.node = dst),
best AS MATERIALIZED (SELECT * FROM g SEMI JOIN lk USING (u, "to") QUALIFY row_number() OVER (PARTITION BY cu, "to" ORDER BY gain DESC, u) = 1),
three AS (SELECT x.u AS n1, y.u AS n2, z.u AS n3, x.cu AS c1, y.cu AS c2, z.cu AS c3, x.gain + y.gain + z.gain AS sum FROM best x JOIN best y ON y.cu = x."to" JOIN best z ON z.cu = y."to" AND z."to" = x.cu WHERE x.cu < y.cu AND x.cu < z.cu AND y.cu <> z.cu)
SELECT c1, c2, c3, n1, n2, n3, round(sum - 2 * (p.b + q.b + r.b), 9) + 0.0 AS gain FROM three JOIN b p ON p.u = n1 AND p.v = n2 JOIN b q ON q.u = n2 AND q.v = n3 JOIN b r ON r.u = n1 AND r.v = n3"""
SQL["ejection_chains"] = with_("sym deg mem", "").rstrip() + ", " + _CHAINS


@query("ejection_chains")
def _ejection_chains(s: SparkSession, d: str) -> DataFrame:
    """(c1, c2, c3, n1, n2, n3, gain): what passing the best movers round three regions would raise modularity by."""
    state, arcs = lo.start(tb.nation_trade(s, d), tb.nation_nodes(s, d))
    state = cut(state.drop("community").join(tb.regions(s, d), "node"), "level")
    rows = ml.chains(state, cut(arcs, "arcs"), 1, 25).filter("closed")
    return rows.select("c1", "c2", "c3", "n1", "n2", "n3", tidy(F.col("gain")).alias("gain"))
