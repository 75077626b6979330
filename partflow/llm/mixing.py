"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets: each source's weighted share of all words, stopped at `ceiling` times its own words, the excess shared again by weight
(water-filling over the sorted ratios of ceiling to weight). A source is dealt into shards by a seeded hash of its documents; words (the
equal blocks that are shared out hold one each, so that the smallest source comes near its target) go to sources, then to each source's
shards, by highest quotients target / (2 k + 1). A shard's documents stand in seeded order on a line of words that is closed to a ring; its
quota is whole passes over the ring and a rest. From a seeded start the ring is cut into blocks of BLOCK words, of which the rest takes
whole ones at even steps and, for the words that are short of a block, the beginning of the first. So a shard gives exactly its quota, and
what a document gives is a closed form of its place: no block is ever a row.

Defined cases: null text has size 0; a null source is a source of its own, last in order; words are counted, so empty texts take
nothing; rows with equal doc_id are told apart by their text; equal rows stand one after another on the line, so their amounts may
differ, but reruns give the same amounts to as many of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, salted_lookup, stored, table

BLOCK = 32  #: words picked together
SHARD_WORDS = 500_000  #: of a source in one shard, about
CEILING = 3
SEED = 20_24


def _unit(*parts) -> Column:
    """60 seeded bits of md5 as a long, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def place(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A document's seeded place in its source."""
    return _unit(F.lit(str(seed)), F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), F.md5(text.cast("binary")))


def sized(docs: DataFrame, seed: int = SEED, extra: dict[str, Column] | None = None) -> DataFrame:
    """What the mix needs of every row; extra: columns to carry along."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(f"({WORD})")).cast("long").alias("size"),
        place(F.col("doc_id"), text, seed).alias("place"), *[c.alias(n) for n, c in (extra or {}).items()],
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = CEILING) -> DataFrame:
    """A row per source: source_size, weight, target. Ordered by code points (binary collation), null last."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    by = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by) - 1, F.lit(n)) + 1).cast("int")).cast("double"))
    cap = (F.col("source_size") * ceiling).cast("double")
    lean = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())  # the soonest full first
    before, all_ = lean.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("full", F.col("ratio") <= F.col("level"))
    # sources are full up to some point of the order; behind it the computed level only falls, so the largest is the one that holds
    last = F.max(F.when(~F.col("full"), F.col("level"))).over(all_)
    return per.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * last).alias("target"))


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str], out: str) -> DataFrame:
    """Sainte-Lague seats. `seats` is a column that is constant in each group. Most seats follow from a divisor a little above the
    ideal one; the few that are left go to the highest quotients votes / (2 k + 1), ties to the first in `order`."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    p = parties.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_v", F.sum(votes).over(w))
    share = F.when(F.col("_v") > 0, F.col(votes) / F.col("_v")).otherwise(F.lit(0.0))
    p = p.withColumn("_base", F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("_n") / 2.0) + 0.5 - 1e-9)).cast("long"))
    p = p.withColumn("_left", F.col(seats) - F.sum("_base").over(w))
    more = F.ceil(share * F.col("_n")) + 2  # no party is owed more of what is left
    q = p.filter((F.col("_left") > 0) & (F.col(votes) > 0)).select(*group, *[o for o in order if o not in group], "_left", "_base", votes, F.explode(F.sequence(F.lit(0), more.cast("int"))).alias("_k"))
    top = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(
        (F.col(votes) / (2 * (F.col("_base") + F.col("_k")) + 1)).desc(), *[F.col(o).asc_nulls_last() for o in order], "_k"
    )
    won = q.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= F.col("_left"))
    keys = list(dict.fromkeys([*group, *order]))
    won = won.groupBy(*keys).agg(F.count(F.lit(1)).alias("_won")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_won")
    on = F.lit(True)
    for k in keys:
        on = on & p[k].eqNullSafe(won[f"_k_{k}"])
    return p.join(won, on, "left").withColumn(out, F.col("_base") + F.coalesce("_won", F.lit(0))).drop("_n", "_v", "_base", "_left", "_won", *[f"_k_{k}" for k in keys])


def shard_quotas(sizes: DataFrame, weights=(1, 2, 3), ceiling: int = CEILING, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents with their shard, quotas of words for each shard)."""
    targets = source_targets(sizes, weights, ceiling)
    all_ = Window.partitionBy()
    seats = apportion(targets.withColumn("all_seats", F.round(F.sum("target").over(all_)).cast("long")), [], "target", "all_seats", ["source"], "seats")
    seats = seats.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("int"))
    dealt = salted_lookup(sizes, seats.select("source", "source_size", "target", "seats", "shards"), ["source"], "doc_id")
    dealt = dealt.withColumn("shard", F.pmod(F.col("place"), F.col("shards")).cast("int"))
    per = dealt.groupBy("source", "shard").agg(F.sum("size").alias("ring"), F.first("seats").alias("seats"), F.first("target").alias("target"))
    per = apportion(per, ["source"], "ring", "seats", ["shard"], "quota")
    return dealt, per.select("source", "shard", F.least("quota", ceiling * F.col("ring")).alias("quota"), "ring")


def mix(sizes: DataFrame, weights=(1, 2, 3), ceiling: int = CEILING, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, place, source_size, target, taken, and the document's words [start, start + size) on its shard's ring of `ring`
    words, which starts to be cut at word `turn` into `blocks` whole blocks; passes and rest words are taken of it."""
    dealt, per = shard_quotas(sizes, weights, ceiling, shard_words)
    line = Window.partitionBy("source", "shard").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0)))
    per = per.select(F.col("source").alias("_src"), F.col("shard").alias("_shd"), "quota", "ring")
    placed = placed.join(per, placed["source"].eqNullSafe(per["_src"]) & (placed["shard"] == per["_shd"]))
    some = F.col("ring") > 0
    placed = placed.withColumn("passes", F.when(some, F.floor(F.col("quota") / F.col("ring"))).otherwise(F.lit(0)).cast("long"))
    placed = placed.withColumn("rest", (F.col("quota") - F.col("passes") * F.col("ring")).cast("long")).withColumn("unit", F.lit(block).cast("long"))
    placed = placed.withColumn("blocks", F.floor(F.col("ring") / block).cast("long")).withColumn("picks", F.least("blocks", F.floor(F.col("rest") / block).cast("long")))
    turn = F.pmod(_unit(F.lit(str(seed)), F.coalesce(F.col("source"), F.lit("")), F.col("shard").cast("string")), F.col("ring"))
    placed = placed.withColumn("turn", F.when(some, turn).otherwise(F.lit(0)))
    ends = F.transform(F.array("start", F.col("start") + F.col("size")), rest_before)  # a lambda, so that its long form is compiled into no stage
    return placed.withColumn("taken", (F.col("passes") * F.col("size") + ends[1] - ends[0]).cast("long")).drop("_src", "_shd", "seats", "shards")


def _from_turn(y: Column) -> Column:
    """Of the ring's first y words from its turn on, those that the rest takes."""
    j = F.least(F.floor(y / F.col("unit")).cast("long"), F.col("blocks"))
    n = F.greatest(F.col("blocks"), F.lit(1))
    before, upto = F.floor(j * F.col("picks") / n).cast("long"), F.floor((j + 1) * F.col("picks") / n).cast("long")
    part = y - j * F.col("unit")
    inside = F.when(j < F.col("blocks"), part * (upto - before)).otherwise(F.lit(0))
    short = F.col("rest") - F.col("picks") * F.col("unit")  # of the first block, which even steps pick only with all others, else of the tail
    last = F.when(F.col("picks") < F.col("blocks"), F.least(y, short)).when(j < F.col("blocks"), F.lit(0)).otherwise(F.least(part, short))
    return before * F.col("unit") + inside + last


def rest_before(x: Column) -> Column:
    """Of the ring's first x words, those that the rest takes."""
    turn, ring = F.col("turn"), F.col("ring")
    tail = _from_turn(ring - turn)
    return F.when(x >= turn, F.col("rest") - tail + _from_turn(x - turn)).otherwise(_from_turn(ring - turn + x) - tail)


def rest_takes(x: Column) -> Column:
    """Whether the rest takes the ring's word x: what rest_before(x + 1) has more than rest_before(x), in a form short enough for a lambda."""
    y = F.pmod(x - F.col("turn"), F.col("ring"))
    j, n = F.floor(y / F.col("unit")).cast("long"), F.greatest(F.col("blocks"), F.lit(1))
    block = (j < F.col("blocks")) & (F.floor((j + 1) * F.col("picks") / n) > F.floor(j * F.col("picks") / n))
    return F.when(F.col("picks") < F.col("blocks"), block | (y < F.col("rest") - F.col("picks") * F.col("unit"))).otherwise(y < F.col("rest"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(sized(table(spark, sf_dir, "documents")), "mix")
    return mix(sizes).select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


def _seats_sql(parties: str, group: str, votes: str, seats: str, order: str, out: str, name: str) -> str:
    part = f"PARTITION BY {group}" if group else ""
    keys = ", ".join(x for x in (group, order) if x)
    on = " AND ".join(f"p.{k} IS NOT DISTINCT FROM w.{k}" for k in keys.split(", "))
    return f"""
{name}_s AS (SELECT *, count(*) OVER ({part}) AS n_, CASE WHEN sum({votes}) OVER ({part}) > 0 THEN {votes} / sum({votes}) OVER ({part})::DOUBLE ELSE 0.0 END AS share_ FROM {parties}),
{name}_b AS (SELECT *, greatest(0, floor(share_ * ({seats} - n_ / 2.0::DOUBLE) + 0.5::DOUBLE - 1e-9::DOUBLE))::BIGINT AS base_ FROM {name}_s),
{name}_p AS (SELECT *, {seats} - sum(base_) OVER ({part}) AS left_ FROM {name}_b),
{name}_q AS (SELECT *, unnest(range(0, (ceil(share_ * n_) + 3)::BIGINT)) AS k_ FROM {name}_p WHERE left_ > 0 AND {votes} > 0),
{name}_r AS (SELECT *, row_number() OVER ({part} ORDER BY {votes} / (2 * (base_ + k_) + 1)::DOUBLE DESC, {order} ASC NULLS LAST, k_) AS r_ FROM {name}_q),
{name}_w AS (SELECT {keys}, count(*) AS won_ FROM {name}_r WHERE r_ <= left_ GROUP BY {keys}),
{name} AS (SELECT p.* EXCLUDE (n_, share_, base_, left_), base_ + coalesce(won_, 0) AS {out} FROM {name}_p p LEFT JOIN {name}_w w ON {on})"""


OP7_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS place
  FROM documents),
per0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
per1 AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, ({CEILING} * source_size)::DOUBLE AS cap FROM per0),
per2 AS (SELECT *, cap / weight AS ratio FROM per1),
per3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM per2
  WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE weight * max(CASE WHEN ratio > level THEN level END) OVER () END AS target FROM per3),
seated AS (SELECT *, round(sum(target) OVER ())::BIGINT AS all_seats FROM targets),
{_seats_sql("seated", "", "target", "all_seats", "source", "seats", "by_source")},
dealt AS (SELECT s.*, source_size, target, seats, place % greatest(1, ceil(source_size / {SHARD_WORDS}::DOUBLE))::BIGINT AS shard
  FROM sizes s JOIN by_source b ON s.source IS NOT DISTINCT FROM b.source),
shards AS (SELECT source, shard, sum(size)::BIGINT AS ring, first(seats) AS seats FROM dealt GROUP BY source, shard),
{_seats_sql("shards", "source", "ring", "seats", "shard", "quota0", "by_shard")},
quotas AS (SELECT *, least(quota0, {CEILING} * ring)::BIGINT AS quota, ring // {BLOCK} AS blocks,
         CASE WHEN ring > 0 THEN ('0x' || substr(md5('{SEED}:' || coalesce(source, '') || ':' || shard::VARCHAR), 1, 15))::BIGINT % ring ELSE 0 END AS turn FROM by_shard),
rests AS (SELECT *, CASE WHEN ring > 0 THEN quota // ring ELSE 0 END AS passes, CASE WHEN ring > 0 THEN quota % ring ELSE 0 END AS rest FROM quotas),
picked AS (SELECT *, least(blocks, rest // {BLOCK}) AS picks FROM rests),
placed AS (
  SELECT d.*, ring, blocks, turn, passes, rest, picks, rest - picks * {BLOCK} AS short,
         coalesce(sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM dealt d JOIN picked q ON d.source IS NOT DISTINCT FROM q.source AND d.shard = q.shard),
-- how many of the ring's first y words from its turn on the rest takes, for both ends of a document and the ring's own end
ends AS (SELECT *, [a, a + size, 0] AS xs FROM placed),
ys AS (SELECT *, [CASE WHEN x >= turn THEN x - turn ELSE ring - turn + x END FOR x IN xs] AS y FROM ends),
js AS (SELECT *, [least(v // {BLOCK}, blocks) FOR v IN y] AS j FROM ys),
ts AS (SELECT *, [(i * picks // greatest(blocks, 1)) * {BLOCK}
         + CASE WHEN i < blocks THEN (y[k] - i * {BLOCK}) * ((i + 1) * picks // greatest(blocks, 1) - i * picks // greatest(blocks, 1)) ELSE 0 END
         + CASE WHEN picks < blocks THEN least(y[k], short) WHEN i < blocks THEN 0 ELSE least(y[k] - i * {BLOCK}, short) END FOR i, k IN j] AS t FROM js)
SELECT doc_id, source, size::BIGINT AS size, source_size, target,
       (passes * size + (t[2] + CASE WHEN a + size >= turn THEN rest ELSE 0 END) - (t[1] + CASE WHEN a >= turn THEN rest ELSE 0 END))::BIGINT AS taken
FROM ts
"""
