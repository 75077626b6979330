"""Line dedup by site-relative frequency, in DataFrame operations.

A page's lines are the text between its block tags. On each host a line's ratio is the share of the host's pages that contain it; lines
over RATIO, on MIN_PAGES pages at least, are boilerplate and go from every page of the host. A host has at most (mean distinct lines of
a page) / RATIO such lines, so they travel as one array of line hashes a host, repeated over salts for hosts with very many pages.

Defined cases: null html has no lines; pages whose url is null or has no host are kept whole; a line repeated on a page counts once for
the ratio and goes each time; rows with equal page_id are pages of their own; a page of any length is one row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_lookup, stored, table

RATIO = 0.3
MIN_PAGES = 3
BLOCK_TAGS = "p|div|nav|ul|ol|li|br|hr|h[1-6]|article|section|header|footer|main|aside|table|thead|tbody|tr|td|th|title|head|body|html|blockquote|pre|form|option|figure|figcaption"
STEPS = (  # (pattern, replacement), in order; the same text in Java and RE2
    (r"(?is)<(script|style|noscript|template)[^>]*>.*?</(script|style|noscript|template)[^>]*>|<!--.*?-->", "\n"),
    (r"\s+", " "),
    (rf"(?i)</?({BLOCK_TAGS})([ /][^>]*)?>", "\n"),
    (r"<[^>]*>", ""),
    (r" *\n[ \n]*", "\n"),
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
HOST = r"^[a-z][a-z0-9+.-]*://([^/?#:@]+)"


def page_lines(html: Column) -> Column:
    text = F.coalesce(html.cast("string"), F.lit(""))
    for pattern, to in STEPS:
        text = F.regexp_replace(text, pattern, to)
    for name, to in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(to))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text (the lines that stay) of every page."""
    host = F.regexp_extract(F.lower("url"), HOST, 1)
    cut = stored(pages.select("page_id", F.when(host != "", host).alias("host"), page_lines(F.col("html")).alias("lines")), "lines")
    cut = cut.withColumn("marks", F.transform("lines", lambda x: F.xxhash64(x)))
    sited = cut.filter("host is not null")
    totals = sited.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    on = sited.select("host", F.explode(F.array_distinct("marks")).alias("mark")).groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    common = on.join(totals, "host").filter(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("mark").alias("common"))
    rows = salted_lookup(cut, common, ["host"], "page_id")
    stay = F.when(F.col("common").isNull(), F.col("lines")).otherwise(
        F.transform(F.filter(F.arrays_zip("lines", "marks"), lambda x: ~F.array_contains(F.col("common"), x["marks"])), lambda x: x["lines"])
    )
    return rows.withColumn("stay", stay).select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"), F.array_join("stay", "\n").alias("text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "pages"))


def _lines_sql() -> str:
    text = "coalesce(html, '')"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, '{pattern}', {'chr(10)' if to == chr(10) else repr(to)}, 'g')"
    for name, to in ENTITIES:
        quoted = to.replace("'", "''")
        text = f"replace({text}, '{name}', '{quoted}')"
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


OP9_SQL = f"""
WITH c AS (SELECT page_id, nullif(regexp_extract(lower(url), '{HOST}', 1), '') AS host, {_lines_sql()} AS lines FROM pages),
t AS (SELECT host, count(*) AS pages FROM c WHERE host IS NOT NULL GROUP BY host),
l AS (SELECT host, unnest(list_distinct(lines)) AS line FROM c WHERE host IS NOT NULL),
n AS (SELECT host, line, count(*) AS n FROM l GROUP BY host, line),
b AS (SELECT host, list(line) AS common FROM n JOIN t USING (host) WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages GROUP BY host),
s AS (SELECT page_id, c.host, lines, CASE WHEN common IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(common, x)) END AS stay FROM c LEFT JOIN b ON c.host = b.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(stay))::BIGINT AS n_dropped, coalesce(array_to_string(stay, chr(10)), '') AS text FROM s
"""
