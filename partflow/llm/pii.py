"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Base spans: emails, addresses, card and phone numbers by pattern, with their checks; their values are the protected entities. A term t
close to an entity c (one of the NEAR words that begin before it, or of the NEAR that begin at or after its end) discloses c as far as it foretells it: the corpus gives PMI(c; t) = log2(n_ct N / (n_c n_t))
against the most there is to know, IC(c) = log2(N / n_c), over documents. A term seen with an entity in MIN_TEXTS different contexts or
more whose PMI / IC reaches GENERALISE becomes a wider class (its shape), from REMOVE on it goes; such terms are spans of the kinds
`generalise` and `remove` beside the base ones.

Positions come from cutting the text at the matches: gaps and matches alternate, so running lengths give code points. Patterns are
possessive and start at the head of a run, so a text of any length is scanned once.

Defined cases: null text is empty; without a match every count is 0 and base_sha256 is that of the empty string; copies of a text count
as one context; rows with equal or null doc_id are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, with possessive runs for Java.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same for RE2, as the contract has them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SIGN = {"email": "@", "ip": ".", "card": "", "phone": "+"}  #: a character without which there is no match
OCTETS = r"^0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(\.0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])){3}$"
NEAR = 5  #: words on either side of an entity
MIN_TEXTS = 3
GENERALISE, REMOVE = 0.7, 0.85


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.regexp_like(m, F.lit(OCTETS))
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


CHUNK = 256  #: matches whose places are summed together
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _bound(value: Column, f) -> Column:
    """f(value), with value computed once: an expression inside a lambda is computed for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def placed(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, in code points, end exclusive. Running lengths are summed by chunks of matches, then
    over chunks, so that no array grows by one match at a time."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m")))

    def cut(parts):
        last = F.floor((F.greatest(F.size(parts), F.lit(1)) - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(parts, k * CHUNK + 1, CHUNK))

    def begin(chunks):
        return F.aggregate(
            chunks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, c: F.struct(F.aggregate(c, acc["at"], lambda n, x: n + x["g"] + x["n"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        )["out"]

    def inside(chunk, at):
        return F.aggregate(
            chunk,
            F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["g"] + x["n"]).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["n"]).alias("end"), x["m"].alias("value"))).alias("out")),
        )["out"]

    return _bound(parts, lambda p: _bound(cut(p), lambda c: F.flatten(F.zip_with(c, begin(c), inside))))


def spans(text: Column, kind: str) -> Column:
    """Array of (start, end, value) of the valid matches, in code points, end exclusive."""
    maybe = F.contains(text, F.lit(SIGN[kind])) if SIGN[kind] else F.regexp_like(text, F.lit("[0-9]"))
    return F.when(maybe, F.filter(placed(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))).otherwise(F.array().cast(_SPAN))


MARKS = ".,;:!?()[]\"\u00ab\u00bb"  #: trimmed from both ends of a word to make a term


def term(word: Column) -> Column:
    return F.trim(F.lower(word), F.lit(MARKS))


def _numbered(docs: DataFrame) -> DataFrame:
    """Stored base spans with a number for each row: rid, doc_id, one array for each kind, words (of texts with an entity, else null)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("*", *[spans(F.col("text"), k).alias(k) for k in KINDS])
    some = F.greatest(*[F.size(k) for k in KINDS]) > 0
    return stored(rows.select("rid", "doc_id", *KINDS, F.when(some, placed(F.col("text"), WORD)).alias("words")), "pii")


def _around(known: DataFrame) -> DataFrame:
    """(rid, entity, context, start, end, term) of the words near entities that hold no base span. Words and the edges of entities are
    sorted in each text; running counts then give the numbers of the words around each entity."""
    words = known.filter("words is not null").select("rid", F.explode("words").alias("w"))
    all_ = F.concat(*[F.transform(k, lambda x, n=n: F.struct(F.lit(n).alias("k"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["value"]).alias("value"))) for n, k in enumerate(KINDS)])
    entities = known.filter("words is not null").select("rid", F.explode(all_).alias("e"))
    # before the words that begin where it does: an entity's edges; what is 1 is counted
    first = entities.select("rid", F.col("e.start").alias("at"), F.lit(0).alias("what"), "e", F.lit(None).cast("struct<start:int,end:int,value:string>").alias("w"))
    last = entities.select("rid", F.col("e.end").alias("at"), F.lit(-1).alias("what"), "e", F.lit(None).cast("struct<start:int,end:int,value:string>").alias("w"))
    lines = words.select("rid", F.col("w.start").alias("at"), F.lit(1).alias("what"), F.lit(None).cast("struct<k:int,start:int,end:int,value:string>").alias("e"), "w")
    order = Window.partitionBy("rid").orderBy("at", "what").rowsBetween(Window.unboundedPreceding, 0)
    line = lines.unionByName(first).unionByName(last)
    line = line.withColumn("n", F.sum(F.when(F.col("what") == 1, 1).otherwise(0)).over(order))
    line = line.withColumn("reach", F.max("e.end").over(order))  # of entities that begin at or before
    line = stored(line, "line")
    held = (F.col("reach") > F.col("w.start")) | (F.col("next") < F.col("w.end"))
    ahead = Window.partitionBy("rid").orderBy(F.desc("at"), F.desc("what")).rowsBetween(Window.unboundedPreceding, -1)  # from the end, so that it runs on
    line = line.withColumn("next", F.min(F.when(F.col("what") == 0, F.col("at"))).over(ahead))
    told = line.filter("what = 1").select("rid", "n", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.value").alias("value"), F.coalesce(held, F.lit(False)).alias("held"))
    before = line.filter("what = 0").select("rid", "e", F.explode(F.sequence(F.col("n") - (NEAR - 1), F.col("n"))).alias("n"))
    after = line.filter("what = -1").select("rid", "e", F.explode(F.sequence(F.col("n") + 1, F.col("n") + NEAR)).alias("n"))
    near = before.unionByName(after).join(told, ["rid", "n"]).withColumn("t", term(F.col("value"))).filter("not held and t <> ''")
    near = stored(near.select("rid", "e", "n", "start", "end", F.col("t").alias("term")), "around")
    context = near.groupBy("rid", "e").agg(F.xxhash64(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]), " ")).alias("context"))
    return near.join(context, ["rid", "e"]).select("rid", F.col("e.value").alias("entity"), "context", "start", "end", "term")


def disclosing(docs: DataFrame, known: DataFrame, min_texts: int = MIN_TEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(rid, kind, start, end) of the terms that disclose an entity near them."""
    near = stored(_around(known), "near")
    in_texts = near.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= min_texts)
    pairs = near.select("entity", "term", "rid").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct")).join(in_texts, ["entity", "term"])
    total = known.count()
    n = F.lit(float(total))
    values = F.concat(*[F.transform(k, lambda x: F.lower(x["value"])) for k in KINDS])
    of_entity = known.filter("words is not null").select("rid", F.explode(F.array_distinct(values)).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    # a term is in the corpus at least as often as it is near entities: that bounds its share from above and leaves few terms to count
    at_least = near.select("term", "rid").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    pairs = pairs.join(of_entity, "entity").join(at_least, "term").filter(F.col("n_c") < total)
    pairs = stored(pairs.filter(F.log2(F.col("n_ct") * n / (F.col("n_c") * F.col("n_near"))) / F.log2(n / F.col("n_c")) >= generalise).drop("n_near"), "pairs")
    none = known.sparkSession.createDataFrame([], "rid bigint, kind string, start int, end int")
    if pairs.isEmpty():
        return none
    terms = pairs.select("term").distinct()
    words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"({WORD})"), F.lit(1)), term))).alias("term"))
    of_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(terms, "term")  # counted first: a row a term reaches the join
    pmi = F.log2(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t")))
    told = pairs.join(of_term, "term").withColumn("share", pmi / F.log2(n / F.col("n_c")))
    told = told.filter(F.col("share") >= generalise).select("entity", "term", "share")
    return near.join(told, ["entity", "term"]).groupBy("rid", "start", "end").agg(F.max("share").alias("share")).select("rid", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("kind"), "start", "end")


def find_private(docs: DataFrame) -> DataFrame:
    """rid, doc_id, the base arrays by kind and `added`, the array of (kind, start, end) of disclosing terms."""
    known = _numbered(docs)
    added = disclosing(docs, known).groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return known.drop("words").join(added, "rid", "left").withColumn("added", F.coalesce("added", none))


def _joined(parts: list[Column]) -> Column:
    return F.array_join(F.flatten(F.array(*parts)), ",")


def _written(found: Column, kind: Column) -> Column:
    return F.transform(found, lambda x: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string")))


def _cuts(found: Column, to: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), to.alias("to")))


def digests(found: DataFrame) -> DataFrame:
    base = [_written(F.col(k), F.lit(k)) for k in KINDS]
    more = F.transform("added", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined([*base, more]).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and the text with entities as [KIND], generalised terms as [TERM], and disclosing terms removed. Where spans
    overlap, the one that starts first holds, and of those the longest."""
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    numbered = stored(numbered, "texts")
    found = find_private(numbered.select(F.col("rid").alias("doc_id"), "text")).drop("rid").withColumnRenamed("doc_id", "rid")
    base = [_cuts(F.col(k), F.lit(f"[{k.upper()}]")) for k in KINDS]
    more = F.transform("added", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), F.when(x["kind"] == "remove", "").otherwise("[TERM]").alias("to")))
    both = numbered.join(found, "rid").withColumn("cuts", F.sort_array(F.flatten(F.array(*base, more))))
    end = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate(
        "cuts", end,
        lambda acc, x: F.when(x["start"] >= acc["at"], F.struct((-x["end"]).alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), x["to"]).alias("out"))).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return both.select("doc_id", text.alias("text"))


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_private(table(spark, sf_dir, "documents")))


def _places_sql() -> str:
    """Code points before the i-th match, from the gaps and matches so far."""
    return "(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT"


def _kind_sql(n: int, kind: str) -> str:
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda j: CASE WHEN (length({digits}) - j) % 2 = 1 THEN 2 * substr({digits}, j, 1)::INT - CASE WHEN substr({digits}, j, 1)::INT > 4 THEN 9 ELSE 0 END ELSE substr({digits}, j, 1)::INT END)) % 10 = 0)"
    valid = {"email": "true", "ip": f"regexp_matches(v, '{OCTETS}')", "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 9 AND 15"}[kind]
    return f"""SELECT rid, {n} AS k, '{kind}' AS kind, s, s + length(v) AS e, v FROM (SELECT rid, f[i] AS v, {_places_sql()} AS s FROM (
      SELECT rid, f, g, unnest(range(1, len(f) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{PLAIN[kind]}') AS f, string_split_regex(t, '{PLAIN[kind]}') AS g FROM d))) WHERE {valid}"""


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
b AS ({" UNION ALL ".join(_kind_sql(n, k) for n, k in enumerate(KINDS))}),
w0 AS (SELECT rid, regexp_extract_all(t, '{WORD}') AS f, string_split_regex(t, '{WORD}') AS g FROM d WHERE rid IN (SELECT rid FROM b)),
w1 AS (SELECT rid, unnest(range(1, len(f) + 1)) AS n, unnest(f) AS word, unnest(g[1:len(f)]) AS gap FROM w0),
w2 AS (SELECT rid, n, word, sum(length(gap) + length(word)) OVER (PARTITION BY rid ORDER BY n)::BIGINT AS z FROM w1),
w AS (SELECT rid, n, z - length(word) AS a, z, trim(lower(word), '{MARKS}') AS term FROM w2),
x AS (SELECT b.*, (SELECT count(*) FROM w WHERE w.rid = b.rid AND a < s) AS before, (SELECT count(*) FROM w WHERE w.rid = b.rid AND a < e) AS inside FROM b),
y AS (SELECT x.rid, k, s, e, v, n, a, z, term FROM x JOIN w ON w.rid = x.rid AND (n BETWEEN before - {NEAR - 1} AND before OR n BETWEEN inside + 1 AND inside + {NEAR})
  WHERE term <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.rid = w.rid AND b.s < z AND b.e > a)),
c AS (SELECT rid, k, s, string_agg(term, ' ' ORDER BY n) AS context FROM y GROUP BY 1, 2, 3),
near AS (SELECT rid, lower(v) AS entity, context, a, z, term FROM y JOIN c USING (rid, k, s)),
pairs AS (SELECT entity, term, count(DISTINCT rid) AS n_ct FROM near GROUP BY 1, 2 HAVING count(DISTINCT context) >= {MIN_TEXTS}),
nc AS (SELECT lower(v) AS entity, count(DISTINCT rid) AS n_c FROM b GROUP BY 1),
nt AS (SELECT term, count(*) AS n_t FROM (SELECT DISTINCT rid, trim(lower(unnest(regexp_extract_all(t, '{WORD}'))), '{MARKS}') AS term FROM d) GROUP BY 1),
told AS (SELECT entity, term, log2(n_ct * n::DOUBLE / (n_c * n_t)) / log2(n::DOUBLE / n_c) AS share FROM pairs JOIN nc USING (entity) JOIN nt USING (term), (SELECT count(*) AS n FROM d) WHERE n_c < n),
more AS (SELECT rid, a, z, CASE WHEN max(share) >= {REMOVE} THEN 'remove' ELSE 'generalise' END AS kind FROM near JOIN told USING (entity, term) WHERE share >= {GENERALISE} GROUP BY 1, 2, 3),
base AS (SELECT rid, {", ".join(f"count(*) FILTER (k = {n}) AS n_{k}" for n, k in enumerate(KINDS))}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM b GROUP BY rid),
added AS (SELECT rid, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY kind, a, z) AS spans FROM more GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base.spans, '')) AS base_sha256, concat_ws(',', base.spans, added.spans) AS spans
FROM d LEFT JOIN base USING (rid) LEFT JOIN added USING (rid)
"""
