"""Phrase mining by contiguous pattern growth, a PrefixSpan over occurrence pointers.

1. A task reads chunks of whole texts, cuts them into pieces and words, and writes each chunk as numbers of its own distinct (lang, word)
   pairs, and those pairs once with their counts. Their sums give each language's n and the frequent words.
2. Every chunk gets the ids of its frequent words (a join; no vocabulary is broadcast). From each frequent word points an occurrence
   pointer at the next three frequent words of its piece. A chunk hands equal pointers on once, with their number.
3. Pointers are dealt to buckets by prefix: the words up to the first one that isn't hot. Words that make up 1/HOT of all words or more
   are hot; there are at most HOT of them. So a prefix is whole in one task, except those of hot words alone, whose extensions are prefixes
   of their own and whose counts are summed over tasks.
4. A task sorts a bucket's pointers, so that every projection is a run, and grows prefixes to the right depth first, entering a run only if
   its support reaches MIN.
5. Cuts, containment and ranks are joins and aggregates over the frequent phrases.

A bucket is sized by what was counted in step 1, BUCKET pointers on average; no count, window or list is capped.

Defined cases: null text has no words; a null lang is `und`, with those that say so; rows without a doc_id and equal rows count as any
other; texts of any length are cut whole, a text longer than a chunk is a chunk; phrases with equal score and count are ordered by their
bytes; a language without candidates and an empty table give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import flat, packed, salted_lookup, ship, shuffle_partitions, slices, stored, table, unpacked
from .word_bpe import spread

MIN = 30  #: least support of a phrase
WORDS = 4  #: most words of a phrase
SHARE = 80  #: percent of a phrase's occurrences that a longer one may hold before it goes
TOP = 2000
HOT = 256
CHUNK = 2_000_000  #: bytes of text in a chunk, about
BUCKET = 1_000_000  #: pointers in a bucket, on average
PARTITION = 32  #: buckets in a partition, where there are more than shuffle partitions
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2


def words_in(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words of all rows in a line, row of each, whether a piece begins with it)."""
    data, edge = flat(col)
    low = _LOWER[data]
    kind = _KIND[low]
    ink = kind == 0
    first = np.zeros(len(low) + 1, bool)
    first[edge] = True
    start = np.flatnonzero(ink & (np.append(True, ~ink[:-1])[: len(ink)] | first[:-1]))
    end = np.flatnonzero(ink & (np.append(~ink[1:], True)[: len(ink)] | first[1:])) + 1
    row = np.searchsorted(edge, start, "right") - 1
    breaks = np.zeros(len(low) + 1, np.int32)
    np.cumsum(kind == 2, out=breaks[1:])
    opens = np.ones(len(start), bool)
    opens[1:] = (row[1:] != row[:-1]) | (breaks[start[1:]] != breaks[end[:-1]])
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(low[ink].tobytes()))
    return words, row, opens


CHUNKS = "chunk string, line binary, langs array<string>, of binary, texts array<string>"


def _chunks(batches):
    """Each chunk: its words as numbers, negative where a piece begins, and its distinct (lang, word) pairs with counts."""
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        for b in slices(batch, 1, CHUNK):
            words, row, opens = words_in(b.column(1))
            if not len(words):
                continue
            lang = b.column(0).dictionary_encode()
            coded = words.dictionary_encode()
            key = np.asarray(lang.indices).astype(np.int64)[row] * len(coded.dictionary) + np.asarray(coded.indices)
            names, code, n = np.unique(key, return_inverse=True, return_counts=True)
            line = (code + 1).astype(np.int32) * np.where(opens, -1, 1).astype(np.int32)
            texts = coded.dictionary.take(pa.array(names % len(coded.dictionary)))
            of = np.column_stack([names // len(coded.dictionary), n]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{k}"]), pa.array([packed(line[None])], pa.binary()), pa.array([lang.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([of.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)],
                names=["chunk", "line", "langs", "of", "texts"],
            )
            k += 1


NAMES = "chunk string, code int, lang string, word string, n bigint"


def _names(batches):
    """The distinct (lang, word) pairs of each chunk as rows."""
    for batch in batches:
        for chunk, langs, of, texts in zip(*(batch.column(c) for c in range(4)), strict=True):
            of, langs, texts = np.frombuffer(of.as_py(), np.int64).reshape(-1, 2), langs.values, texts.values
            for at in range(0, len(of), 50_000):
                o = of[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk.as_py()]).take(pa.array(np.zeros(len(o), np.int32))), pa.array(np.arange(at, at + len(o), dtype=np.int32)), langs.take(pa.array(o[:, 0])), texts.slice(at, len(o)), pa.array(o[:, 1])],
                    names=["chunk", "code", "lang", "word", "n"],
                )


def project(line: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pointers of a chunk, a column (id, next, next, next) each with 0 behind a piece's end or an infrequent word, and how often each occurs.

    ids: frequent word's id by number, 0 for others."""
    at = ids[np.abs(line) - 1]
    opens = line < 0
    out = np.zeros((WORDS, len(at)), np.int32)
    out[0] = at
    goes = at > 0
    for k in range(1, WORDS):
        goes = goes[:-1] & (at[k:] > 0) & ~opens[k:]
        out[k, : len(goes)] = np.where(goes, at[k:], 0)
    out = out[:, out[1] > 0]
    order = walk_order(out)
    out = out[:, order]
    new = np.append(True, (out[:, 1:] != out[:, :-1]).any(0)) if len(order) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    return out[:, head], np.diff(np.append(head, len(order)))


def walk_order(words: np.ndarray) -> np.ndarray:
    """Pointers in the order of their words."""
    first, last = words[0].astype(np.int64), words[2].astype(np.int64)
    for key, low in ((first, words[1]), (last, words[3])):
        key <<= 32
        key |= low
    return np.lexsort((last, first))


def is_hot(word: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which numbers are among the sorted ones of `hot`."""
    if not len(hot):
        return np.zeros(len(word), bool)
    return hot[np.minimum(np.searchsorted(hot, word), len(hot) - 1)] == word


def bucket_of(pointers: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pointer by its words up to the first that isn't hot."""
    name, goes = np.zeros(pointers.shape[1], np.uint64), np.ones(pointers.shape[1], bool)
    for word in pointers:
        mixed = (name ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        name = np.where(goes, mixed, name)
        goes = goes & is_hot(word, hot)
    return (name % np.uint64(buckets)).astype(np.int64)


def _pointers(hot: np.ndarray, buckets: int):
    """(bucket, pointers and their numbers) of each chunk."""

    def run(batches):
        for batch in batches:
            for line, known in zip(batch.column(0), batch.column(1), strict=True):
                if not known.is_valid:
                    continue
                line = unpacked(line.as_py(), 1)[0]
                ids = np.zeros(int(np.abs(line).max()), np.int64)
                ids[np.asarray(known.values.field("code"))] = np.asarray(known.values.field("id"))
                pointers, n = project(line, ids)
                bucket = bucket_of(pointers, hot, buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, rows = bucket[order], np.vstack([pointers, n])[:, order]
                head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
                for i, j in zip(head.tolist(), [*head[1:].tolist(), len(bucket)], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[i])], pa.int32()), pa.array([packed(rows[:, i:j])], pa.binary())], names=["bucket", "pointers"])

    return run


def grow(pointers: np.ndarray, n: np.ndarray, hot: np.ndarray, least: int = MIN):
    """(prefix of 2 to 4 words padded by 0, support) of pointers, in the order of a depth-first walk. A projection is a run of the sorted
    pointers; runs with less than `least` support aren't entered, but for prefixes of hot words, which other buckets may hold too."""
    order = walk_order(pointers)
    words, n = pointers[:, order], n[order]
    del pointers, order
    live = np.ones(len(n), bool)
    change = np.append(True, words[0, 1:] != words[0, :-1]) if len(n) else np.zeros(0, bool)
    found, places = [], []
    apart = is_hot(words[0], hot)
    for depth in range(1, WORDS):  # all runs of one depth at once; a run's parts are inside it
        change = change | np.append(True, words[depth, 1:] != words[depth, :-1])[: len(change)]
        apart = apart & is_hot(words[depth], hot)
        live = live & (words[depth] > 0)
        head = np.flatnonzero(change)
        support = np.add.reduceat(n, head) if len(head) else np.zeros(0, np.int64)
        enter = live[head] & ((support >= least) | (apart[head] if depth < WORDS - 1 else False))
        rows = np.zeros((int(enter.sum()), WORDS), np.int64)
        rows[:, : depth + 1] = words[: depth + 1, head[enter]].T
        found.append(np.column_stack([rows, support[enter]]))
        places.append(np.column_stack([head[enter], np.full(len(rows), depth)]))
        live = np.repeat(enter, np.diff(np.append(head, len(n))))
    found, places = np.concatenate(found), np.concatenate(places)
    return found[np.lexsort((places[:, 1], places[:, 0]))]


PHRASES = "w1 bigint, w2 bigint, w3 bigint, w4 bigint, f bigint"


def _laid(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pointers, their numbers) of packed parts, each unpacked into its place; a part goes from the list when it is."""
    width = 4 * (WORDS + 1)
    size = [int.from_bytes(p[:8], "little") // width for p in parts]
    pointers, n, end = np.empty((WORDS, sum(size)), np.int32), np.empty(sum(size), np.int64), sum(size)
    while parts:
        start = end - size.pop()
        rows = unpacked(parts.pop(), WORDS + 1)
        pointers[:, start:end], n[start:end], end = rows[:WORDS], rows[WORDS], start
    return pointers, n


def _grown(hot: np.ndarray, least: int):
    """A partition has its buckets one after another; each is grown when it is whole."""

    def out(parts):
        found = grow(*_laid(parts), hot, least)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(5)], names=["w1", "w2", "w3", "w4", "f"])

    def run(batches):
        held, bucket = [], None
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket and held:
                    yield out(held)
                    held = []
                    pa.default_memory_pool().release_unused()
                bucket = b
                held.append(raw.as_py())
        if held:
            yield out(held)

    return run


def _number(words: DataFrame) -> DataFrame:
    """ids from 1 on for a table's rows: places in its partitions behind the sizes of the partitions before."""
    spark = words.sparkSession
    placed = stored(words.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a number a partition
    before, starts = 1, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    offsets = spark.createDataFrame(starts, "p bigint, start bigint")
    return placed.join(F.broadcast(offsets), part == F.col("p")).select(*words.columns, (F.col("start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))


def mine(docs: DataFrame, least: int = MIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(n of each lang, frequent words: id, lang, word, f; frequent phrases: w1 .. w4, f)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    chunks = stored(rows.filter("text is not null").mapInArrow(_chunks, CHUNKS), "chunks")
    names = chunks.select("chunk", "langs", "of", "texts").mapInArrow(_names, NAMES)  # made twice rather than stored beside the chunks
    counts = stored(names.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = stored(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    words = stored(_number(counts.filter(F.col("f") >= least)), "frequent")
    if words.count() >= 1 << 31:
        raise OverflowError("more frequent words than 32-bit ids")
    known = names.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("code", "id")).alias("ids"))
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = np.array([r["id"] for r in words.filter(F.col("f") * HOT >= total).select("id").orderBy("id").collect()], np.int64)  # HOT at most
    buckets = max(shuffle_partitions(spark), -(-total // BUCKET))
    pointers = chunks.select("chunk", "line").join(known, "chunk").select("line", "ids").mapInArrow(_pointers(hot, buckets), "bucket int, pointers binary")
    parts = max(shuffle_partitions(spark), -(-buckets // PARTITION))
    dealt = pointers.repartition(parts, "bucket").sortWithinPartitions("bucket")
    phrases = dealt.mapInArrow(_grown(hot, least), PHRASES).groupBy("w1", "w2", "w3", "w4").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return totals, words, stored(phrases, "phrases")


def _big(x: Column) -> Column:
    return x.cast("decimal(24,0)")


def _part(first: int, size: int) -> Column:
    """Words first .. first + size - 1 (from 1) of a phrase, padded by 0, as one key."""
    return F.struct(*[(F.col(f"w{first + k}") if k < size else F.lit(0).cast("bigint")).alias(f"w{k + 1}") for k in range(WORDS)])


def collocations(docs: DataFrame, least: int = MIN, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    totals, words, phrases = mine(docs, least)
    size = F.when(F.col("w4") > 0, 4).when(F.col("w3") > 0, 3).otherwise(2)
    phrases = phrases.withColumn("size", size).withColumn("phrase_id", F.xxhash64("w1", "w2", "w3", "w4"))
    support = phrases.select(_part(1, WORDS).alias("key"), "f")
    none = F.lit(0).cast("bigint")
    support = stored(support.unionByName(words.select(F.struct(F.col("id").alias("w1"), none.alias("w2"), none.alias("w3"), none.alias("w4")).alias("key"), "f")), "support")
    # longer phrases over the parts inside them
    inner = [(s, at, size) for s in range(3, WORDS + 1) for size in range(2, s) for at in range(1, s - size + 2)]
    held = phrases.filter("size > 2").select("f", F.explode(F.array(*[F.when(F.col("size") == s, _part(at, k)) for s, at, k in inner])).alias("key")).filter("key is not null")
    held = held.groupBy("key").agg(F.max("f").alias("longer"))
    left = phrases.withColumn("key", _part(1, WORDS))
    left = left.join(held, "key", "left").filter(F.col("longer").isNull() | (_big(F.col("longer")) * 100 < _big(F.col("f")) * share)).select("phrase_id", "w1", "w2", "w3", "w4", "size", F.col("f").alias("a"))
    left = stored(left, "candidates")
    # every cut, with the supports of both sides
    cuts = [(s, k) for s in range(2, WORDS + 1) for k in range(1, s)]
    sides = F.explode(F.array(*[F.when(F.col("size") == s, F.struct(F.lit(k).alias("k"), _part(1, k).alias("head"), _part(k + 1, s - k).alias("tail"))) for s, k in cuts])).alias("cut")
    cut = left.select("*", sides).filter("cut is not null").select("*", F.col("cut.k").alias("k"), F.col("cut.head").alias("head"), F.col("cut.tail").alias("tail")).drop("cut")
    cut = salted_lookup(cut, support.select(F.col("key").alias("head"), F.col("f").alias("l")), ["head"], "phrase_id", grows=True)
    cut = salted_lookup(cut, support.select(F.col("key").alias("tail"), F.col("f").alias("r")), ["tail"], "phrase_id", grows=True)
    score = F.expr("(cast(a as decimal(24,0)) * 2000000) div (cast(l as decimal(24,0)) + cast(r as decimal(24,0)))")
    best = cut.withColumn("score", score).groupBy("phrase_id", "w1", "w2", "w3", "w4", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # words in place of ids
    spelt = best.select("*", F.posexplode(F.array("w1", "w2", "w3", "w4")).alias("place", "id")).filter("id > 0")
    spelt = salted_lookup(spelt, words.select("id", "lang", "word"), ["id"], "phrase_id", grows=True)
    spelt = spelt.groupBy("phrase_id", "w1", "w2", "w3", "w4", "a", "best").agg(F.max("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("parts"))
    spelt = spelt.select("lang", F.array_join(F.col("parts.word"), " ").alias("phrase"), "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"), "phrase_id")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.col("phrase_id"), F.lit(16))
    few = spelt.withColumn("_at", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("_at") <= top)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return few.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (SELECT lang, unnest([w[i:i], CASE WHEN i + 1 <= len(w) THEN w[i:i + 1] END, CASE WHEN i + 2 <= len(w) THEN w[i:i + 2] END, CASE WHEN i + 3 <= len(w) THEN w[i:i + 3] END]) AS p FROM starts),
f AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM grams WHERE p IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE len(p) = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, p, f AS a FROM f WHERE len(p) > 1 AND f >= 30),
subs AS (SELECT lang, a, p, unnest(range(2, len(p))) AS size FROM cand),
parts AS (SELECT lang, a, p, size, unnest(range(1, len(p) - size + 2)) AS o FROM subs),
held AS (SELECT lang, p[o:o + size - 1] AS p, max(a) AS longer FROM parts GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN held h USING (lang, p) WHERE h.longer IS NULL OR 100 * h.longer::HUGEINT < 80 * c.a::HUGEINT),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM kept),
scored AS (SELECT c.lang, c.p, c.a, c.k, l.f AS l, r.f AS r, (2000000 * c.a::HUGEINT) // (l.f + r.f) AS score FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.p = c.p[1:c.k] JOIN f r ON r.lang = c.lang AND r.p = c.p[c.k + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
