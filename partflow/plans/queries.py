"""Queries over the library's operators, each with SQL that computes the same another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partflow.functions import metrics as me
from partflow.functions import partition as pt
from partflow.functions.metrics import tidy
from partflow.operators import contract as co
from partflow.sources import graphs as gr
from partflow.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Named SQL relations that oracle texts pick from.
CTE = {
    "edges": """SELECT least(c_nationkey, s_nationkey)::BIGINT AS src, greatest(c_nationkey, s_nationkey)::BIGINT AS dst, count(*)::DOUBLE AS w
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2""",
    "sym": "SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges WHERE src <> dst",
    "deg": "SELECT src AS node, sum(w) AS a FROM sym GROUP BY 1",
    "vol": "SELECT sum(a) AS m FROM deg",
    "nodes": "SELECT n_nationkey::BIGINT AS node, n_name AS label, n_regionkey::BIGINT AS region FROM nation",
    "mem": "SELECT n_nationkey::BIGINT AS node, n_regionkey::BIGINT AS community FROM nation",
    "mem4": "SELECT n_nationkey::BIGINT AS node, (n_nationkey % 4)::BIGINT AS community FROM nation",
    "med": "SELECT quantile_disc(w, 0.5) AS q FROM edges",
    "strong": "SELECT src, dst, w FROM edges, med WHERE w > q",
    "must": "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT), (1, 2)) t(u, v)",
    "cannot": "SELECT * FROM (VALUES (0::BIGINT, 3::BIGINT), (4, 9)) t(u, v)",
    "comp": "SELECT node, (CASE WHEN node <= 2 THEN 0 ELSE node - 2 END)::BIGINT AS comp FROM nodes",
    "ins": "SELECT x.community, sum(w) AS inside FROM sym JOIN mem x ON src = x.node JOIN mem y ON dst = y.node WHERE x.community = y.community GROUP BY 1",
    "tot": "SELECT community, sum(a) AS total FROM mem JOIN deg USING (node) GROUP BY 1",
    "mod": "SELECT t.community, coalesce(inside, 0) / m - (total / m) * (total / m) AS score FROM tot t LEFT JOIN ins USING (community) CROSS JOIN vol",
    "cells": "SELECT x.community AS a, y.community AS b, count(*) AS n FROM mem x JOIN mem4 y USING (node) GROUP BY 1, 2",
    "ndual": "SELECT node, (node % 7) / 1000.0::DOUBLE AS value FROM nodes",
    "pdual": "SELECT src AS u, dst AS v, ((src + dst) % 5) / 500.0::DOUBLE AS value FROM strong",
    "soft": "SELECT src AS node, community, sum(w) / max(t) AS share FROM sym JOIN mem ON dst = mem.node JOIN (SELECT src AS s, sum(w) AS t FROM sym GROUP BY 1) ON src = s GROUP BY 1, 2",
    "pool": "SELECT 1 AS part_id, node, community FROM mem UNION ALL SELECT 2, node, community FROM mem4 UNION ALL SELECT 3, node, node % 3 FROM nodes",
}
NEEDS = {"sym": ["edges"], "deg": ["sym"], "vol": ["deg"], "med": ["edges"], "strong": ["edges", "med"], "comp": ["nodes"], "ins": ["sym", "mem"], "tot": ["mem", "deg"], "mod": ["tot", "ins", "vol"], "cells": ["mem", "mem4"], "ndual": ["nodes"], "pdual": ["strong"], "soft": ["sym", "mem"], "pool": ["mem", "mem4", "nodes"]}


def with_(names: str, body: str) -> str:
    """SQL text with the named relations and what they need, in order of need."""
    out: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, ()):
            add(x)
        if n not in out:
            out.append(n)

    for n in names.split():
        add(n)
    return ("WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in out) + "\n" if out else "") + body


def query(name: str, needs: str = "", sql: str | None = None):
    def put(f):
        QUERIES[name] = tb.makes_once(f)
        if sql is not None:
            SQL[name] = with_(needs, sql)
        return f

    return put


def pairs_of(spark: SparkSession, *rows: tuple[int, int]) -> DataFrame:
    return spark.createDataFrame(list(rows), "u bigint, v bigint")


def must_links(spark: SparkSession) -> DataFrame:
    return pairs_of(spark, (0, 1), (1, 2))


def cannot_links(spark: SparkSession) -> DataFrame:
    return pairs_of(spark, (0, 3), (4, 9))


def strong_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the nation graph above the median weight."""
    e = tb.nation_trade(spark, d)
    return e.crossJoin(F.broadcast(e.agg(F.expr("percentile_disc(0.5) within group (order by w)").alias("q")))).filter("w > q").select("src", "dst", "w")


def node_duals(spark: SparkSession, d: str) -> DataFrame:
    return tb.nation_nodes(spark, d).select("node", (F.pmod("node", F.lit(7)) / 1000.0).alias("value"))


def pair_duals(spark: SparkSession, d: str) -> DataFrame:
    return strong_edges(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v"), (F.pmod(F.col("src") + F.col("dst"), F.lit(5)) / 500.0).alias("value"))


def nation_components(spark: SparkSession, d: str) -> DataFrame:
    return co.link_components(tb.nation_nodes(spark, d), must_links(spark))


def pool(spark: SparkSession, d: str) -> DataFrame:
    third = tb.nation_nodes(spark, d).select(F.lit(3).alias("part_id"), "node", F.pmod("node", F.lit(3)).alias("community"))
    return tb.regions(spark, d).select(F.lit(1).alias("part_id"), "node", "community").unionByName(tb.quarters(spark, d).select(F.lit(2).alias("part_id"), "node", "community")).unionByName(third)


# ------------------------------------------------------------------ sources

query("graph_params", "edges sym deg vol", "SELECT node, a, m FROM deg, vol")(lambda s, d: gr.degrees(tb.nation_trade(s, d)).crossJoin(F.broadcast(gr.volume(tb.nation_trade(s, d)))))
query("graph_unweighted", "edges", "SELECT src, dst, 1.0::DOUBLE AS w FROM edges")(lambda s, d: gr.unweighted(tb.nation_trade(s, d)))
query("undirected_noloop", "sym", "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(w) AS w FROM sym WHERE src <> dst GROUP BY 1, 2")(lambda s, d: gr.undirected(gr.both_ways(tb.nation_trade(s, d))))
query("signed_layers", "strong edges med", "SELECT CASE WHEN w > q THEN 0 ELSE 1 END AS layer, src, dst, abs(w - q) AS w FROM edges, med WHERE w <> q")(
    lambda s, d: gr.signed_layers(tb.nation_trade(s, d).crossJoin(F.broadcast(tb.nation_trade(s, d).agg(F.expr("percentile_disc(0.5) within group (order by w)").alias("q")))).select("src", "dst", (F.col("w") - F.col("q")).alias("w")))
)
query("symmetrize", "edges", "SELECT src, dst, sum(w) * 0.5::DOUBLE AS w FROM (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges) GROUP BY 1, 2")(lambda s, d: gr.symmetrize(tb.nation_trade(s, d)))
query("stable_adjlist", "sym", "SELECT src AS node, string_agg(dst || ':' || w::BIGINT, ',' ORDER BY dst) AS neighbours FROM sym WHERE src <> dst GROUP BY 1")(
    lambda s, d: gr.adjacency_lists(tb.nation_trade(s, d)).select("node", F.array_join(F.transform("neighbours", lambda x: F.concat_ws(":", x["dst"].cast("string"), x["w"].cast("long").cast("string"))), ",").alias("neighbours"))
)
query("edges_by_attr", "edges med", "SELECT src, dst FROM edges, med WHERE w > q")(
    lambda s, d: gr.by_attribute(tb.nation_trade(s, d).join(strong_edges(s, d).select("src", "dst", F.lit("worthy").alias("kind")), ["src", "dst"], "left"), "kind", "worthy").select("src", "dst")
)
query("nodes_by_attr", "nodes", "SELECT node FROM nodes WHERE region IS NOT NULL AND region <> 0")(lambda s, d: gr.by_attribute(tb.nation_nodes(s, d), "region").select("node"))


def label_pairs(s: SparkSession, d: str) -> DataFrame:
    n = tb.nation_nodes(s, d)
    return tb.nation_trade(s, d).join(n.select(F.col("node").alias("src"), F.col("label").alias("v")), "src").join(n.select(F.col("node").alias("dst"), F.col("label").alias("u")), "dst").select("u", "v")


query("map_pairs", "edges", "SELECT src AS u, dst AS v FROM edges")(lambda s, d: gr.map_pairs(label_pairs(s, d), tb.nation_nodes(s, d)))
query("unknown_labels", "", "SELECT DISTINCT o_orderstatus AS label FROM orders UNION SELECT 'nowhere'")(
    lambda s, d: gr.unknown_labels(tb.table(s, d, "orders").select(F.col("o_orderstatus").alias("u"), F.lit("nowhere").alias("v")), tb.nation_nodes(s, d))
)
_INCIDENCE = """WITH i AS (SELECT DISTINCT l_suppkey::BIGINT AS c, l_orderkey::BIGINT AS v, CASE WHEN o_orderstatus = 'F' THEN 'integer' ELSE 'continuous' END AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a.c AS src, b.c AS dst, count(*) AS weight, string_agg(a.v::VARCHAR, ',' ORDER BY a.v) AS variables, string_agg(DISTINCT a.k, ',' ORDER BY a.k) AS var_types,
CASE WHEN min((a.k = 'integer')::INT) = 1 THEN 'integer' ELSE 'continuous' END AS var_type FROM i a JOIN i b ON a.v = b.v AND a.c < b.c GROUP BY 1, 2"""


@query("incidence_graph", "", _INCIDENCE)
def _incidence(s, d):
    g = gr.incidence_graph(tb.order_incidence(s, d))
    return g.withColumns({"variables": F.array_join(F.transform("variables", lambda x: x.cast("string")), ","), "var_types": F.array_join("var_types", ",")})


query("supplier_graph", "", "SELECT a.l_suppkey::BIGINT AS src, b.l_suppkey::BIGINT AS dst, count(*)::DOUBLE AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")(tb.supplier_orders)
query("two_hop", "strong", "SELECT DISTINCT a.src AS u, b.dst AS v FROM (SELECT src, dst FROM strong UNION SELECT dst, src FROM strong) a JOIN (SELECT src, dst FROM strong UNION SELECT dst, src FROM strong) b ON a.dst = b.src WHERE a.src < b.dst AND NOT EXISTS (SELECT 1 FROM strong x WHERE x.src = a.src AND x.dst = b.dst)")(
    lambda s, d: gr.two_hop(strong_edges(s, d))
)
query("plot_partition_cells", "sym mem", "SELECT a.p AS i, b.p AS j, w, a.community = b.community AS same FROM sym JOIN (SELECT *, row_number() OVER (ORDER BY community, node) - 1 AS p FROM mem) a ON src = a.node JOIN (SELECT *, row_number() OVER (ORDER BY community, node) - 1 AS p FROM mem) b ON dst = b.node")(
    lambda s, d: gr.matrix_cells(tb.nation_trade(s, d), tb.regions(s, d)).withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long")})
)

# ------------------------------------------------------------------ partitions

query("coassoc_pairs", "mem", "SELECT a.node AS i, b.node AS j FROM mem a JOIN mem b ON a.community = b.community AND a.node < b.node")(lambda s, d: pt.coassociation(tb.regions(s, d)))
query("canonical_labels", "mem", "SELECT node, dense_rank() OVER (ORDER BY f) - 1 AS community FROM (SELECT node, min(node) OVER (PARTITION BY community) AS f FROM mem)")(lambda s, d: pt.relabel_first(tb.regions(s, d)).withColumn("community", F.col("community").cast("long")))
query("relabel_first", "mem4", "SELECT node, dense_rank() OVER (ORDER BY f) - 1 AS community FROM (SELECT node, min(node) OVER (PARTITION BY (3 - community)) AS f FROM mem4)")(
    lambda s, d: pt.relabel_first(tb.quarters(s, d).withColumn("community", 3 - F.col("community"))).withColumn("community", F.col("community").cast("long"))
)
query("relabel_sorted", "mem4", "SELECT node, 3 - community AS community FROM mem4")(lambda s, d: pt.relabel_sorted(tb.quarters(s, d).withColumn("community", 10 * (3 - F.col("community")))).withColumn("community", F.col("community").cast("long")))
query("communities", "mem", "SELECT dense_rank() OVER (ORDER BY min(node)) AS community, string_agg(node::VARCHAR, ',' ORDER BY node) AS nodes FROM mem GROUP BY mem.community")(
    lambda s, d: pt.communities(tb.regions(s, d)).select(F.col("community").cast("long").alias("community"), F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"))
)
query("community_labels", "mem nodes", "SELECT label, community FROM mem JOIN nodes USING (node)")(lambda s, d: tb.regions(s, d).join(tb.nation_nodes(s, d).select("node", "label"), "node").select("label", "community"))
query("threshold_partition", "nodes", "SELECT node, CASE WHEN node / 24.0 > 0.5 THEN 1 ELSE 0 END AS community FROM nodes")(lambda s, d: pt.threshold_partition(tb.nation_nodes(s, d).select("node", (F.col("node") / 24.0).alias("r"))))
query("sign_split", "nodes", "SELECT node, CASE WHEN node > 12 THEN 1 ELSE -1 END AS side, count(*) OVER (PARTITION BY node > 12) AS size FROM nodes")(lambda s, d: pt.sign_split(tb.nation_nodes(s, d).select("node", (F.col("node") - 12.0).alias("x"))))
query("soft_membership", "soft", "SELECT node, community, round(share, 9) + 0.0 AS share FROM soft")(lambda s, d: pt.soft_membership(tb.nation_trade(s, d), tb.regions(s, d)).withColumn("share", tidy(F.col("share"))))
query("prob_threshold", "soft", "SELECT node, CASE WHEN max(share) < 0.22 THEN -1 ELSE arg_max(community, round(share, 12) - community * 1e-14) END::BIGINT AS label FROM soft GROUP BY node")(
    lambda s, d: pt.label_by_threshold(pt.soft_membership(tb.nation_trade(s, d), tb.regions(s, d)), 0.22)
)
query("simple_partition", "nodes cannot", "SELECT node, 0 AS community, (SELECT count(*) FROM cannot WHERE u = node OR v = node) AS apart FROM nodes")(lambda s, d: _simple(s, d))


def _simple(s: SparkSession, d: str) -> DataFrame:
    """(node, community, apart): the one community, and from how many nodes the column nevertheless keeps a node."""
    one, pairs = pt.simple_partition(tb.nation_nodes(s, d), cannot_links(s))
    kept = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("apart"))
    return one.join(kept, "node", "left").select("node", "community", F.coalesce("apart", F.lit(0)).alias("apart"))



query("round_robin", "nodes", "SELECT node, ((row_number() OVER (ORDER BY node) - 1) % 4)::INT AS community FROM nodes")(lambda s, d: pt.round_robin(tb.nation_nodes(s, d), 4))
query("block_repair", "mem", "SELECT node, round_even(avg(node % 2) OVER (PARTITION BY community), 0) AS x FROM mem")(
    lambda s, d: pt.block_repair(tb.regions(s, d).select("node", F.pmod("node", F.lit(2)).cast("double").alias("x")), tb.regions(s, d).select("node", F.col("community").alias("block")), True)
)
query("refine_with_cp", "mem4", "SELECT node, CASE WHEN node < 5 THEN -1 ELSE community END AS community FROM mem4")(lambda s, d: pt.refine_with_core(tb.quarters(s, d), tb.nation_nodes(s, d).filter("node < 5").select("node")))
query("refine_linear_group", "soft", "SELECT node, CASE WHEN max(share) < 0.2 THEN -1 ELSE arg_max(community, round(share, 12) - community * 1e-14) END::BIGINT AS label FROM soft GROUP BY node")(
    lambda s, d: pt.label_by_threshold(pt.soft_membership(tb.nation_trade(s, d), tb.regions(s, d)), 0.2)
)

# ------------------------------------------------------------------ joins

query("edges_within_communities", "edges mem", "SELECT src, dst, w, a.community FROM edges JOIN mem a ON src = a.node JOIN mem b ON dst = b.node WHERE a.community = b.community")(
    lambda s, d: tb.nation_trade(s, d).join(tb.regions(s, d).withColumnRenamed("node", "src"), "src").join(tb.regions(s, d).select(F.col("node").alias("dst"), F.col("community").alias("c2")), "dst").filter("community = c2").select("src", "dst", "w", "community")
)
query("unworthy_edges", "edges strong", "SELECT src, dst, w FROM edges EXCEPT SELECT src, dst, w FROM strong")(lambda s, d: co.unworthy_edges(tb.nation_trade(s, d), strong_edges(s, d).select(F.col("src").alias("u"), F.col("dst").alias("v"))))


def violations(pool_: DataFrame, cannot: DataFrame, must: DataFrame) -> DataFrame:
    """(part_id, broken): pool columns that break cannot-links or must-links, and how many."""
    x, y = pool_.select("part_id", F.col("node").alias("u"), F.col("community").alias("cu")), pool_.select("part_id", F.col("node").alias("v"), F.col("community").alias("cv"))
    bad = cannot.join(x, "u").join(y, ["part_id", "v"]).filter("cu = cv").unionByName(must.join(x, "u").join(y, ["part_id", "v"]).filter("cu <> cv"))
    return bad.groupBy("part_id").agg(F.count(F.lit(1)).alias("broken"))


query("violated_columns", "pool cannot must", "SELECT x.part_id, count(*) AS broken FROM (SELECT u, v, 0 AS kind FROM cannot UNION ALL SELECT u, v, 1 FROM must) p JOIN pool x ON p.u = x.node JOIN pool y ON p.v = y.node AND x.part_id = y.part_id WHERE (kind = 0) = (x.community = y.community) GROUP BY 1")(
    lambda s, d: violations(pool(s, d), cannot_links(s), must_links(s))
)
query("positive_dual_pairs", "nodes", "SELECT a.node AS u, b.node AS v, (a.node % 7 - 3 + b.node % 7 - 3)::BIGINT AS total FROM nodes a JOIN nodes b ON a.node < b.node WHERE (a.node % 7 - 3) + (b.node % 7 - 3) < 0")(
    lambda s, d: negative_pairs(tb.nation_nodes(s, d).select("node", (F.pmod("node", F.lit(7)) - 3).cast("long").alias("value")))
)


BANDS = 64


def negative_pairs(duals: DataFrame, bands: int = BANDS) -> DataFrame:
    """(u, v, total): node pairs u < v whose duals sum below zero: such a pair gains weight when the duals are taken off.

    Values are cut at quantiles into bands. A node meets the bands whose least value is small enough, which are the first few, so all but the
    last band it meets hold pairs only that are wanted, and no band's rows meet rows they can't belong to."""
    cuts = duals.agg(F.percentile_approx("value", [k / bands for k in range(1, bands)]).alias("cuts"), F.min("value").alias("low")).first()
    if cuts["low"] is None:
        return duals.select(F.col("node").alias("u"), F.col("node").alias("v"), F.col("value").alias("total")).limit(0)
    lows = [cuts["low"], *sorted({c for c in cuts["cuts"] if c > cuts["low"]})]
    reach = F.lit(-1)
    for low in lows:
        reach = reach + (F.col("x") + F.lit(low) < 0).cast("int")
    band = F.lit(-1)
    for low in lows:
        band = band + (F.col("y") >= F.lit(low)).cast("int")
    a = duals.select(F.col("node").alias("u"), F.col("value").alias("x")).withColumn("reach", reach).filter("reach >= 0").select("u", "x", F.explode(F.sequence(F.lit(0), F.col("reach"))).alias("band"))
    b = duals.select(F.col("node").alias("v"), F.col("value").alias("y")).withColumn("band", band)
    return a.join(b, "band").filter("u < v and x + y < 0").select("u", "v", (F.col("x") + F.col("y")).alias("total"))



query("pairs_union", "strong cannot", "SELECT src AS u, dst AS v FROM strong UNION SELECT u, v FROM cannot")(lambda s, d: strong_edges(s, d).select(F.col("src").alias("u"), F.col("dst").alias("v")).union(cannot_links(s)).distinct())
query("pairs_except", "edges cannot", "SELECT src AS u, dst AS v FROM edges EXCEPT SELECT u, v FROM cannot")(lambda s, d: tb.nation_trade(s, d).select(F.col("src").alias("u"), F.col("dst").alias("v")).exceptAll(cannot_links(s)).distinct())
query("pairs_intersect", "edges must", "SELECT src AS u, dst AS v FROM edges INTERSECT SELECT u, v FROM must")(lambda s, d: tb.nation_trade(s, d).select(F.col("src").alias("u"), F.col("dst").alias("v")).intersect(must_links(s)))

# ------------------------------------------------------------------ metrics

query("modularity", "mod", "SELECT round(sum(score), 9) + 0.0 AS modularity FROM mod")(lambda s, d: me.modularity(tb.nation_trade(s, d), tb.regions(s, d)).select(tidy(F.col("modularity")).alias("modularity")))
query("modularity_by_community", "mod", "SELECT community, round(score, 9) + 0.0 AS score FROM mod")(lambda s, d: me.modularity_by_community(tb.nation_trade(s, d), tb.regions(s, d)).select("community", tidy(F.col("score")).alias("score")))
query("modularity_rollup", "mod", "SELECT community, round(sum(score), 9) + 0.0 AS score FROM mod GROUP BY ROLLUP (community)")(lambda s, d: me.modularity_by_community(tb.nation_trade(s, d), tb.regions(s, d)).rollup("community").agg(tidy(F.sum("score")).alias("score")))
query("modularity_gamma", "tot ins vol", "SELECT round(sum(coalesce(inside, 0) / m - 0.5 * (total / m) * (total / m)), 9) + 0.0 AS modularity FROM tot LEFT JOIN ins USING (community) CROSS JOIN vol")(
    lambda s, d: me.modularity(tb.nation_trade(s, d), tb.regions(s, d), 0.5).select(tidy(F.col("modularity")).alias("modularity"))
)
query("dual_weights", "strong ndual pdual", "SELECT src AS u, dst AS v, round((a.value + b.value) / 2 + p.value / 2, 9) + 0.0 AS weight FROM strong JOIN ndual a ON src = a.node JOIN ndual b ON dst = b.node JOIN pdual p ON p.u = src AND p.v = dst")(
    lambda s, d: me.dual_weights(strong_edges(s, d).select(F.col("src").alias("u"), F.col("dst").alias("v")), node_duals(s, d), pair_duals(s, d)).withColumn("weight", tidy(F.col("weight")))
)
_RC = "SELECT (SELECT sum(score) FROM mod) AS f, (SELECT sum(value * size) FROM ndual JOIN mem USING (node) JOIN (SELECT community, count(*) AS size FROM mem GROUP BY 1) USING (community)) + (SELECT coalesce(sum(value), 0) FROM pdual JOIN mem a ON u = a.node JOIN mem b ON v = b.node WHERE a.community = b.community) AS g"
query("reduced_cost", "mod ndual pdual mem", f"SELECT round(f - g - 0.125, 9) + 0.0 AS reduced_cost FROM ({_RC})")(lambda s, d: _cost(s, d).select(tidy(F.col("reduced_cost")).alias("reduced_cost")))
query("reduced_cost_details", "mod ndual pdual mem", f"SELECT round(f, 9) + 0.0 AS modularity_term, round(g, 9) + 0.0 AS dual_term, 0.125::DOUBLE AS constant, round(f - g - 0.125, 9) + 0.0 AS reduced_cost FROM ({_RC})")(
    lambda s, d: _cost(s, d).select(*[tidy(F.col(c)).alias(c) if c != "constant" else F.col(c) for c in ("modularity_term", "dual_term", "constant", "reduced_cost")])
)


def _cost(s: SparkSession, d: str) -> DataFrame:
    return me.reduced_cost(tb.nation_trade(s, d), tb.regions(s, d), node_duals(s, d), pair_duals(s, d), 0.125)


query("contingency", "cells", "SELECT a, b, n FROM cells")(lambda s, d: me.contingency(tb.regions(s, d), tb.quarters(s, d)))
_MI = """SELECT sum(-n / t * log2(na / t)) AS ha, sum(-n / t * log2(nb / t)) AS hb, sum(n / t * log2(n * t / (na * nb))) AS mi, sum(n * (n - 1) / 2) AS p, max(t) AS t FROM
(SELECT n::DOUBLE AS n, sum(n) OVER ()::DOUBLE AS t, sum(n) OVER (PARTITION BY a)::DOUBLE AS na, sum(n) OVER (PARTITION BY b)::DOUBLE AS nb FROM cells)"""
_PAIRS = "(SELECT sum(x * (x - 1) / 2) AS pa FROM (SELECT sum(n)::DOUBLE AS x FROM cells GROUP BY a)), (SELECT sum(x * (x - 1) / 2) AS pb FROM (SELECT sum(n)::DOUBLE AS x FROM cells GROUP BY b))"
for _name, _column, _expression in (
    ("entropy", "h_a", "ha"), ("mutual_info", "mutual_info", "mi"), ("nmi", "nmi", "2 * mi / (ha + hb)"), ("vi", "vi", "ha + hb - 2 * mi"),
    ("ari", "ari", "(p - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2))"), ("partition_hamming", "hamming", "(pa + pb - 2 * p) / (t * (t - 1) / 2)"),
):
    query(_name, "cells", f"SELECT round({_expression}, 9) + 0.0 AS {_column} FROM ({_MI}), {_PAIRS}")(lambda s, d, c=_column: me.agreement(tb.regions(s, d), tb.quarters(s, d)).select(tidy(F.col(c)).alias(c)))
query("optimality_gap", "mod tot ins vol", "SELECT round((t - f) * 100 / (f + 1e-12), 6) + 0.0 AS gap FROM (SELECT sum(score) AS t FROM mod), (SELECT sum(c.inside / m - (c.total / m) * (c.total / m)) AS f FROM (SELECT x.community, sum(a) AS total, (SELECT coalesce(sum(w), 0) FROM sym JOIN mem4 p ON src = p.node JOIN mem4 q ON dst = q.node WHERE p.community = x.community AND q.community = x.community) AS inside FROM mem4 x JOIN deg USING (node) GROUP BY 1) c, vol)".replace("mem4", "(SELECT n_nationkey::BIGINT AS node, (n_nationkey % 4)::BIGINT AS community FROM nation)"))(
    lambda s, d: me.optimality_gap(tb.nation_trade(s, d), tb.regions(s, d), tb.quarters(s, d)).select(tidy(F.col("gap"), 6).alias("gap"))
)
query("diversity_filter", "pool mem", "SELECT min(h) >= 0.1 AS different FROM (SELECT part_id, avg(((x.community = y.community) <> (p.community = q.community))::INT) AS h FROM pool x JOIN pool y USING (part_id) JOIN mem p ON p.node = x.node JOIN mem q ON q.node = y.node WHERE x.node < y.node AND part_id > 1 GROUP BY 1)")(
    lambda s, d: me.sufficiently_different(tb.regions(s, d), pool(s, d).filter("part_id > 1"), 0.1)
)


@query("permuted_accuracy", "cells", "SELECT round(max(a0.n + a1.n + a2.n + a3.n) / 25.0, 9) AS accuracy FROM (SELECT r.community AS a, q.community AS b, coalesce((SELECT n FROM cells c WHERE c.a = r.community AND c.b = q.community), 0) AS n FROM (SELECT DISTINCT community FROM mem) r, (SELECT DISTINCT community FROM mem4) q) a0, (SELECT r.community AS a, q.community AS b, coalesce((SELECT n FROM cells c WHERE c.a = r.community AND c.b = q.community), 0) AS n FROM (SELECT DISTINCT community FROM mem) r, (SELECT DISTINCT community FROM mem4) q) a1, (SELECT r.community AS a, q.community AS b, coalesce((SELECT n FROM cells c WHERE c.a = r.community AND c.b = q.community), 0) AS n FROM (SELECT DISTINCT community FROM mem) r, (SELECT DISTINCT community FROM mem4) q) a2, (SELECT r.community AS a, q.community AS b, coalesce((SELECT n FROM cells c WHERE c.a = r.community AND c.b = q.community), 0) AS n FROM (SELECT DISTINCT community FROM mem) r, (SELECT DISTINCT community FROM mem4) q) a3 WHERE a0.b = 0 AND a1.b = 1 AND a2.b = 2 AND a3.b = 3 AND a0.a <> a1.a AND a0.a <> a2.a AND a0.a <> a3.a AND a1.a <> a2.a AND a1.a <> a3.a AND a2.a <> a3.a")
def _accuracy(s, d):
    return s.createDataFrame([(round(float(me.permuted_accuracy(tb.regions(s, d), tb.quarters(s, d))[0]), 9),)], "accuracy double")


query("check_balance", "mem", "SELECT min(n) AS smallest, max(n) AS largest, min(n) >= 5 AND max(n) <= 5 AS balanced FROM (SELECT count(*) AS n FROM mem GROUP BY community)")(lambda s, d: me.check_balance(tb.regions(s, d), 5, 5))
query("balance_bounds", "nodes", "SELECT k, greatest(1, floor(n / k::DOUBLE - r / 2.0 + 0.5))::INT AS low, (greatest(1, floor(n / k::DOUBLE - r / 2.0 + 0.5)) + r)::INT AS high FROM (SELECT count(*) AS n FROM nodes), (VALUES (5, 0), (4, 1), (7, 3), (2, 1)) t(k, r)")(
    lambda s, d: s.createDataFrame([(k, *me.balance_bounds(n, k, r)) for n in [tb.nation_nodes(s, d).count()] for k, r in ((5, 0), (4, 1), (7, 3), (2, 1))], "k int, low int, high int")
)
query("feasible_k", "nodes", "SELECT unnest(range(ceil(count(*) / 7.0)::BIGINT, (count(*) // 3 + 1)::BIGINT))::INT AS k FROM nodes")(lambda s, d: s.createDataFrame([(k,) for k in me.feasible_counts(tb.nation_nodes(s, d).count(), 3, 7)], "k int"))
query("target_sizes", "nodes", "SELECT i::INT AS i, (count(*) // 4 + (i < count(*) % 4)::INT)::INT AS size FROM nodes, range(4) t(i) GROUP BY i")(lambda s, d: s.createDataFrame(list(enumerate(me.target_sizes(tb.nation_nodes(s, d).count(), 4))), "i int, size int"))
query("balance_epsilon", "nodes", "SELECT round(greatest(0.0, 7 / (count(*) / 4.0) - 1), 9)::DOUBLE AS epsilon FROM nodes")(lambda s, d: s.createDataFrame([(round(me.upper_slack(tb.nation_nodes(s, d).count(), 4, 7), 9),)], "epsilon double"))


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return tb.regions(s, d).select("node", F.col("community").alias("block"))


query("block_sum_b", "sym mem tot vol", "SELECT x.community AS a, y.community AS b, round(coalesce(s, 0) - x.total * y.total / m, 6) + 0.0 AS excess FROM tot x CROSS JOIN tot y CROSS JOIN vol LEFT JOIN (SELECT p.community AS a, q.community AS b, sum(w) AS s FROM sym JOIN mem p ON src = p.node JOIN mem q ON dst = q.node GROUP BY 1, 2) z ON z.a = x.community AND z.b = y.community")(
    lambda s, d: me.block_excess(tb.nation_trade(s, d), _blocks(s, d)).withColumn("excess", tidy(F.col("excess"), 6))
)
query("block_mean", "sym mem", "SELECT p.community AS a, q.community AS b, round(sum(w) / 25.0, 9) + 0.0 AS mean FROM sym JOIN mem p ON src = p.node JOIN mem q ON dst = q.node WHERE p.community <> q.community GROUP BY 1, 2 UNION ALL SELECT DISTINCT community, community, 1.0::DOUBLE FROM mem")(
    lambda s, d: me.block_means(tb.nation_trade(s, d), _blocks(s, d)).withColumn("mean", tidy(F.col("mean")))
)
query("b_sum", "mod vol", "SELECT round(sum(score) * max(m), 6) + 0.0 AS b_sum FROM mod, vol")(lambda s, d: me.modularity(tb.nation_trade(s, d), tb.regions(s, d)).crossJoin(gr.volume(tb.nation_trade(s, d))).select(tidy(F.col("modularity") * F.col("m"), 6).alias("b_sum")))
_SCORES = "SELECT node, t.community, coalesce(k, 0) / m - a * total / (m * m) AS score FROM deg CROSS JOIN tot t CROSS JOIN vol LEFT JOIN (SELECT src AS node, community, sum(w) AS k FROM sym JOIN mem ON dst = mem.node GROUP BY 1, 2) z USING (node, community)"
query("node_community_scores", "deg tot vol sym mem", f"SELECT node, community, round(score, 12) + 0.0 AS score FROM ({_SCORES}) s WHERE EXISTS (SELECT 1 FROM sym JOIN mem ON dst = mem.node WHERE src = s.node AND mem.community = s.community) OR EXISTS (SELECT 1 FROM mem WHERE mem.node = s.node AND mem.community = s.community)")(
    lambda s, d: me.node_community_scores(tb.nation_trade(s, d), tb.regions(s, d)).withColumn("score", tidy(F.col("score"), 12))
)
query("move_gains", "deg tot vol sym mem", f"SELECT s.node, s.community AS \"to\", round(2 * (s.score - (h.score + a * a / (m * m))), 12) + 0.0 AS gain FROM ({_SCORES}) s JOIN mem ON mem.node = s.node JOIN ({_SCORES}) h ON h.node = s.node AND h.community = mem.community JOIN deg ON deg.node = s.node CROSS JOIN vol WHERE s.community <> mem.community AND EXISTS (SELECT 1 FROM sym JOIN mem y ON dst = y.node WHERE src = s.node AND y.community = s.community)")(
    lambda s, d: me.move_gains(tb.nation_trade(s, d), tb.regions(s, d)).withColumn("gain", tidy(F.col("gain"), 12))
)
query("merge_gains", "sym mem tot vol", "SELECT x.community AS a, y.community AS b, round(2 * (coalesce(s, 0) / m - x.total * y.total / (m * m)), 12) + 0.0 AS gain FROM tot x JOIN tot y ON x.community < y.community CROSS JOIN vol LEFT JOIN (SELECT p.community AS a, q.community AS b, sum(w) AS s FROM sym JOIN mem p ON src = p.node JOIN mem q ON dst = q.node GROUP BY 1, 2) z ON z.a = x.community AND z.b = y.community")(
    lambda s, d: me.merge_gains(tb.nation_trade(s, d), tb.regions(s, d)).withColumn("gain", tidy(F.col("gain"), 12))
)
query("be_score", "edges nodes", "SELECT round(corr(coalesce(w, 0), ((a.node < 6) OR (b.node < 6))::INT), 9) + 0.0 AS score FROM nodes a JOIN nodes b ON a.node < b.node LEFT JOIN edges ON src = a.node AND dst = b.node")(
    lambda s, d: me.be_score(tb.nation_trade(s, d), tb.nation_nodes(s, d).select("node", (F.col("node") < 6).cast("int").alias("c"))).select(tidy(F.col("score")).alias("score"))
)
query("be_score_continuous", "edges nodes", "SELECT round(corr(coalesce(w, 0), (a.node / 24.0) * (b.node / 24.0)), 9) + 0.0 AS score FROM nodes a JOIN nodes b ON a.node < b.node LEFT JOIN edges ON src = a.node AND dst = b.node")(
    lambda s, d: me.be_score(tb.nation_trade(s, d), tb.nation_nodes(s, d).select("node", (F.col("node") / 24.0).alias("c")), False).select(tidy(F.col("score")).alias("score"))
)

# ------------------------------------------------------------------ contraction

query("must_link_components", "comp", "SELECT node, comp FROM comp")(lambda s, d: nation_components(s, d).withColumn("comp", F.col("comp").cast("long")))
query("component_conflicts", "comp cannot", "SELECT DISTINCT least(x.comp, y.comp) AS a, greatest(x.comp, y.comp) AS b FROM cannot JOIN comp x ON u = x.node JOIN comp y ON v = y.node")(lambda s, d: co.component_conflicts(nation_components(s, d), cannot_links(s)).select(F.col("a").cast("long"), F.col("b").cast("long")))
query("link_feasibility", "comp cannot", "SELECT count(*) FILTER (x.comp = y.comp) AS contradictions, count(*) FILTER (x.comp = y.comp) = 0 AS feasible FROM cannot JOIN comp x ON u = x.node JOIN comp y ON v = y.node")(lambda s, d: co.links_feasible(nation_components(s, d), cannot_links(s)))
query("contract_graph", "edges comp", "SELECT least(x.comp, y.comp) AS src, greatest(x.comp, y.comp) AS dst, sum(CASE WHEN x.comp = y.comp THEN 2 * w ELSE w END) AS w FROM edges JOIN comp x ON src = x.node JOIN comp y ON dst = y.node GROUP BY 1, 2")(
    lambda s, d: co.contract_graph(tb.nation_trade(s, d), nation_components(s, d)).select(F.col("src").cast("long"), F.col("dst").cast("long"), "w")
)
query("contract_pairs", "comp cannot", "SELECT DISTINCT least(x.comp, y.comp) AS u, greatest(x.comp, y.comp) AS v FROM cannot JOIN comp x ON u = x.node JOIN comp y ON v = y.node WHERE x.comp <> y.comp")(lambda s, d: co.contract_pairs(cannot_links(s), nation_components(s, d), True).select(F.col("u").cast("long"), F.col("v").cast("long")))
query("contract_partition", "nodes comp", "SELECT comp AS node, max((node >= 10)::BIGINT) AS community FROM nodes JOIN comp USING (node) GROUP BY 1")(
    lambda s, d: co.contract_partition(tb.nation_nodes(s, d).select("node", (F.col("node") >= 10).cast("long").alias("community")), nation_components(s, d)).withColumn("node", F.col("node").cast("long"))
)
query("expand_partition", "comp", "SELECT node, comp % 3 AS community FROM comp")(lambda s, d: co.expand_partition(nation_components(s, d).select(F.col("comp").alias("node"), F.pmod("comp", F.lit(3)).cast("long").alias("community")).distinct(), nation_components(s, d)))
query("aggregate_graph", "edges mem", "SELECT least(x.community, y.community) AS src, greatest(x.community, y.community) AS dst, sum(CASE WHEN x.community = y.community THEN 2 * w ELSE w END) AS w FROM edges JOIN mem x ON src = x.node JOIN mem y ON dst = y.node GROUP BY 1, 2")(lambda s, d: co.aggregate_graph(tb.nation_trade(s, d), tb.regions(s, d)))
query("periphery_components", "nodes strong", None)(lambda s, d: co.periphery_components(strong_edges(s, d), tb.nation_nodes(s, d).filter("node < 10").select("node"), tb.nation_nodes(s, d)).withColumn("community", F.col("community").cast("long")))
SQL["periphery_components"] = with_("nodes strong", """, x AS (SELECT src AS u, dst AS v FROM strong WHERE src >= 10 AND dst >= 10)""").rstrip().replace("\n, x AS", ",\nx AS").replace("WITH ", "WITH RECURSIVE ", 1) + """,
y AS (SELECT u, v FROM x UNION ALL SELECT v, u FROM x),
r AS (SELECT node, node AS reach FROM nodes WHERE node >= 10 UNION SELECT r.node, y.v FROM r JOIN y ON r.reach = y.u)
SELECT node, dense_rank() OVER (ORDER BY m)::BIGINT AS community FROM (SELECT node, min(reach) AS m FROM r GROUP BY 1) UNION ALL SELECT node, 0 FROM nodes WHERE node < 10"""
query("fingerprint_blocks", "pool", "SELECT node, dense_rank() OVER (ORDER BY f) - 1 AS block FROM (SELECT node, min(node) OVER (PARTITION BY k) AS f FROM (SELECT node, string_agg(part_id || ':' || community, ',' ORDER BY part_id) AS k FROM pool GROUP BY 1))")(lambda s, d: co.fingerprint_blocks(pool(s, d)).withColumn("block", F.col("block").cast("long")))
query("coassociation", "pool", "SELECT x.node AS i, y.node AS j, round(count(*) / 3.0, 9) AS share FROM pool x JOIN pool y ON x.part_id = y.part_id AND x.community = y.community AND x.node < y.node GROUP BY 1, 2")(lambda s, d: co.coassociation_share(pool(s, d)).withColumn("share", tidy(F.col("share"))))
_COLOR = "SELECT node, dense_rank() OVER (ORDER BY color, near) - 1 AS color FROM (SELECT c.node, any_value(c.color) AS color, coalesce(string_agg(w::BIGINT || ':' || n.color, ',' ORDER BY w, n.color), '') AS near FROM {0} c LEFT JOIN y ON y.src = c.node LEFT JOIN {0} n ON n.node = y.dst GROUP BY c.node)"
query("color_refinement", "nodes strong", None)(lambda s, d: co.color_refinement(strong_edges(s, d).withColumn("w", F.lit(1.0)), tb.nation_nodes(s, d), 2))
SQL["color_refinement"] = with_("nodes strong", "").rstrip() + f""",
y AS (SELECT src, dst, 1 AS w FROM strong UNION ALL SELECT dst, src, 1 FROM strong), c0 AS (SELECT node, 0 AS color FROM nodes), c1 AS ({_COLOR.format("c0")}), c2 AS ({_COLOR.format("c1")}) SELECT node, color FROM c2"""
query("component_order", "comp", "SELECT comp, row_number() OVER (ORDER BY min(24 - node), comp) - 1 AS position FROM comp GROUP BY comp")(
    lambda s, d: co.component_order(tb.nation_nodes(s, d).select("node", (24 - F.col("node")).alias("pos")), nation_components(s, d)).select(F.col("comp").cast("long").alias("comp"), F.col("position").cast("long").alias("position"))
)
query("weakest_nodes", "deg tot vol sym mem", f"SELECT node, round(score, 12) + 0.0 AS score FROM (SELECT s.node, score, row_number() OVER (PARTITION BY s.community ORDER BY round(score, 12), s.node) AS r FROM ({_SCORES}) s JOIN mem ON mem.node = s.node AND mem.community = s.community) WHERE r <= 2")(lambda s, d: _weakest(s, d))


def _weakest(s: SparkSession, d: str) -> DataFrame:
    own = me.node_community_scores(tb.nation_trade(s, d), tb.regions(s, d)).join(tb.regions(s, d), ["node", "community"]).withColumn("score", tidy(F.col("score"), 12))
    return own.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("score", "node"))).filter("r <= 2").select("node", "score")
