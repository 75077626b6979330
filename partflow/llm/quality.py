"""Quality classifier by hierarchical empirical Bayes, in DataFrame operations.

The document classifier is naive Bayes over a few binned shape features of the whole text, fitted by grouped counts on all labelled
rows. Its posterior under the global rate is a document's evidence. Hosts (the source) and paths (source and language) gather that
evidence from all their documents; a host's rate is shrunk to the global one, a path's to its host's. The prior strengths come from the
spread of the rates between sites (method of moments), so sparse sites stay near their parent. A document's posterior is its own
likelihood ratio on its path's odds; it stays at 0.5 or more.

Defined cases: null text counts as empty; a null source or language is a site of its own; null labels or labels of unknown documents are
ignored, repeated labels of a document count once (the lowest); without labels of both kinds every likelihood ratio is 1 and every
document stays; equal rows get equal results; an empty table gives no rows; other columns are ignored (kept by `keep_good`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, salted_lookup, stored, table, without

BINS = 12
KEEP = 0.5
MOST, LEAST = 10_000.0, 1.0  #: bounds of a prior's strength, in documents
FEATURES = ("symbols", "capitals", "digits", "lines", "length", "marks", "variety")


def _share(a, b) -> Column:
    """Twelfths of a / b, 0 where b is 0."""
    return F.when(b > 0, F.least(F.lit(BINS - 1), F.floor(a * BINS / b))).otherwise(F.lit(0)).cast("int")


def features(docs: DataFrame) -> DataFrame:
    """All columns and an int column for each feature."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("long")

    lines = F.split(t, "\n")
    words = F.split(F.lower(t), " ")
    out = docs.withColumn("_w", count(f"({WORD})")).withColumn("_c", F.length(t).cast("long"))
    return out.select(
        *docs.columns,
        _share(count(r"([*$%#&|!]+)"), F.col("_w")).alias("f_symbols"),
        _share(count("([A-Z])"), F.col("_c")).alias("f_capitals"),
        _share(count("([0-9])"), F.col("_c")).alias("f_digits"),
        _share(F.size(F.array_distinct(lines)), F.size(lines)).alias("f_lines"),
        F.when(F.col("_w") > 0, F.least(F.lit(BINS - 1), F.floor(F.col("_c") / F.col("_w")))).otherwise(F.lit(0)).cast("int").alias("f_length"),
        _share(count(r"([.,;:?])"), F.col("_w")).alias("f_marks"),
        _share(F.size(F.array_distinct(words)), F.size(words)).alias("f_variety"),
    )


def fit(known: DataFrame, labels: DataFrame) -> tuple[dict[str, dict[int, float]], float]:
    """(log likelihood ratios by feature and bin, the global rate). At most len(FEATURES) * BINS rows reach the driver."""
    truth = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = known.join(truth, "doc_id").select("quality", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"f_{f}").alias("bin")) for f in FEATURES])).alias("x"))
    good = F.sum(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good")
    counts = rows.groupBy("x.feature", "x.bin").agg(good, F.count(F.lit(1)).alias("n")).collect()
    of = [r for r in counts if r["feature"] == FEATURES[0]]
    n_good, n = sum(r["good"] for r in of), sum(r["n"] for r in of)
    ratios: dict[str, dict[int, float]] = {f: {} for f in FEATURES}
    if 0 < n_good < n:
        import math

        for r in counts:
            ratios[r["feature"]][r["bin"]] = math.log((r["good"] + 1) / (n_good + BINS)) - math.log((r["n"] - r["good"] + 1) / (n - n_good + BINS))
        unseen = math.log(1 / (n_good + BINS)) - math.log(1 / (n - n_good + BINS))
        for f in FEATURES:
            for b in range(BINS):
                ratios[f].setdefault(b, unseen)
        return ratios, n_good / n
    return ratios, 0.5


def evidence(known: DataFrame, ratios: dict) -> DataFrame:
    """Adds `llr`, the log likelihood ratio of good to bad."""
    total = F.lit(0.0)
    for f in FEATURES:
        cases = [F.lit(float(ratios[f].get(b, 0.0))) for b in range(BINS)]
        total = total + F.element_at(F.array(*cases), F.col(f"f_{f}") + 1)
    return known.withColumn("llr", total)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(rates: DataFrame) -> Column:
    """Prior strength from the spread between sites: mu (1 - mu) / variance - 1, within bounds."""
    n, s = F.sum("n"), F.sum("s")
    mu = s / n
    spread = F.sum(F.col("s") * F.col("s") / F.col("n")) / n - mu * mu
    return F.when(spread > 1e-9, F.greatest(F.lit(LEAST), F.least(F.lit(MOST), mu * (1 - mu) / spread - 1))).otherwise(F.lit(MOST))


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, host, path, llr, host_rate, path_rate, posterior, keep for every row."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"))
    known = stored(features(cols).drop("text"), "features")
    ratios, rate = fit(known, labels)
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    rows = evidence(known, ratios).withColumn("p", 1 / (1 + F.exp(-(F.col("llr") + F.log(F.lit(rate / (1 - rate)))))))
    paths = rows.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    over_hosts, over_paths = hosts.agg((F.sum("s") / F.sum("n")).alias("mu"), _strength(hosts).alias("k")).first(), paths.agg(_strength(paths).alias("k")).first()  # three numbers
    mu, kh, kp = (over_hosts["mu"] if over_hosts["mu"] is not None else rate), over_hosts["k"] or MOST, over_paths["k"] or MOST
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("s") + kh * mu) / (F.col("n") + kh)).alias("host_rate"))
    sites = paths.join(hosts, paths["host"].eqNullSafe(hosts["_host"])).select("host", "path", "host_rate", ((F.col("s") + kp * F.col("host_rate")) / (F.col("n") + kp)).alias("path_rate"))
    out = salted_lookup(rows, sites, ["host", "path"], "doc_id")
    odds = F.col("llr") + _logit(F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("path_rate"))))
    return out.withColumn("posterior", 1 / (1 + F.exp(-odds))).select("doc_id", "host", "path", "llr", "host_rate", "path_rate", "posterior", (F.col("posterior") >= KEEP).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that stay, all their columns. Rows with one doc_id are judged together: by the best of their texts."""
    best = posteriors(docs, labels).groupBy("doc_id").agg(F.max("keep").alias("_keep"))
    return without(docs, best.filter("not _keep and doc_id is not null"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "host", "path", *[F.round(c, 6).alias(c) for c in ("llr", "host_rate", "path_rate", "posterior")], "keep")


def _bin_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN least({BINS - 1}, floor(({a}) * {BINS} / ({b})::DOUBLE)) ELSE 0 END::INT"


def _count_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


_STRENGTH_SQL = f"CASE WHEN sum(s * s / n) / sum(n) - (sum(s) / sum(n)) ** 2 > 1e-9 THEN greatest({LEAST}, least({MOST}, (sum(s) / sum(n)) * (1 - sum(s) / sum(n)) / (sum(s * s / n) / sum(n) - (sum(s) / sum(n)) ** 2) - 1)) ELSE {MOST} END"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, source AS host, lang AS path, coalesce(text, '') AS t FROM documents),
c AS (SELECT *, {_count_sql("[^\\x20\\x09-\\x0D]+")} AS w, length(t) AS n_c, string_split(t, chr(10)) AS ls, string_split(lower(t), ' ') AS ws FROM d),
f AS (SELECT doc_id, host, path,
  {_bin_sql(_count_sql("[*$%#&|!]+"), "w")} AS f0, {_bin_sql(_count_sql("[A-Z]"), "n_c")} AS f1, {_bin_sql(_count_sql("[0-9]"), "n_c")} AS f2,
  {_bin_sql("len(list_distinct(ls))", "len(ls)")} AS f3, CASE WHEN w > 0 THEN least({BINS - 1}, floor(n_c / w::DOUBLE)) ELSE 0 END::INT AS f4,
  {_bin_sql(_count_sql("[.,;:?]"), "w")} AS f5, {_bin_sql("len(list_distinct(ws))", "len(ws)")} AS f6 FROM c),
y AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
l AS (SELECT f.*, q FROM f JOIN y USING (doc_id)),
tot AS (SELECT sum((q > 0)::INT)::DOUBLE AS g, count(*)::DOUBLE AS n FROM l),
long AS (SELECT doc_id, host, path, unnest([0, 1, 2, 3, 4, 5, 6]) AS f, unnest([f0, f1, f2, f3, f4, f5, f6]) AS b FROM f),
cnt AS (SELECT f, b, sum((q > 0)::INT)::DOUBLE AS g, count(*)::DOUBLE AS n FROM long JOIN y USING (doc_id) GROUP BY f, b),
r AS (SELECT f, b, ln((coalesce(cnt.g, 0) + 1) / (tot.g + {BINS})) - ln((coalesce(cnt.n, 0) - coalesce(cnt.g, 0) + 1) / (tot.n - tot.g + {BINS})) AS r
      FROM (SELECT unnest(range(0, 7)) AS f) CROSS JOIN (SELECT unnest(range(0, {BINS})) AS b) CROSS JOIN tot LEFT JOIN cnt USING (f, b)),
e AS (SELECT doc_id, host, path, sum(r) AS llr FROM long JOIN r USING (f, b) GROUP BY doc_id, host, path),
p AS (SELECT *, 1 / (1 + exp(-(llr + ln((g / n) / (1 - g / n))))) AS p FROM e, tot),
paths AS (SELECT host, path, sum(p) AS s, count(*)::DOUBLE AS n FROM p GROUP BY host, path),
hosts AS (SELECT host, sum(s) AS s, sum(n) AS n FROM paths GROUP BY host),
gl AS (SELECT sum(s) / sum(n) AS mu, {_STRENGTH_SQL} AS kh, (SELECT {_STRENGTH_SQL} FROM paths) AS kp FROM hosts),
hr AS (SELECT host, (s + kh * mu) / (n + kh) AS host_rate FROM hosts, gl),
pr AS (SELECT paths.host, path, host_rate, (s + kp * host_rate) / (n + kp) AS path_rate FROM paths JOIN hr ON paths.host IS NOT DISTINCT FROM hr.host, gl),
o AS (SELECT doc_id, p.host, p.path, llr, host_rate, path_rate, 1 / (1 + exp(-(llr + ln(path_rate / (1 - path_rate))))) AS posterior
      FROM p JOIN pr ON p.host IS NOT DISTINCT FROM pr.host AND p.path IS NOT DISTINCT FROM pr.path)
SELECT doc_id, host, path, round(llr, 6) AS llr, round(host_rate, 6) AS host_rate, round(path_rate, 6) AS path_rate, round(posterior, 6) AS posterior, posterior >= {KEEP} AS keep FROM o
"""
