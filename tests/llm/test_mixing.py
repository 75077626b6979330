from collections import defaultdict
from fractions import Fraction

from partflow.llm import mixing as m
from tests.llm.common import corpus, docs, same_as_sql, words


def targets(sizes, weights=(1, 2, 3), ceiling=3):
    """Shares with the excess dealt out again, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = dict.fromkeys(names, Fraction(0)), set(names), Fraction(sum(sizes.values()))
    while left > 0 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            out[s] += left * weight[s] / total
        left = Fraction(0)
        for s in list(open_):
            if out[s] > ceiling * sizes[s]:
                left += out[s] - ceiling * sizes[s]
                out[s] = Fraction(ceiling * sizes[s])
                open_.discard(s)
    return out


def test_equals_sql(spark):
    same_as_sql(m.op7_source_mixing, m.OP7_SQL, spark)


def test_targets_amounts_and_reruns(spark):
    rows = [*corpus(), (905, "again here", "a"), (None, "no id at all", "b"), (903, "Word", "b"), *[(2000 + i, "x " * 300, "small" if i < 1 else "big") for i in range(30)]]
    frame = docs(spark, rows)
    got = m.mix(m.sized(frame), shard_words=500).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(words(r[1]))
    want = targets(sizes)
    assert len(got) == len(rows) and sorted(g["size"] for g in got) == sorted(len(words(r[1])) for r in rows)
    taken = defaultdict(int)
    for g in got:
        assert 0 <= g["taken"] <= 3 * g["size"] and abs(g["target"] - float(want[g["source"]])) < 1e-6
        taken[g["source"]] += g["taken"]
    shards = {s: len({g["shard"] for g in got if g["source"] == s}) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= shards[s] + 1 for s in sizes)
    again = m.mix(m.sized(frame.repartition(5)), shard_words=500).collect()
    assert sorted((str(g["doc_id"]), g["place"], g["taken"]) for g in got) == sorted((str(g["doc_id"]), g["place"], g["taken"]) for g in again)
    assert m.mix(m.sized(docs(spark, []))).count() == 0


def test_seats_are_the_highest_quotients(spark):
    votes = {"a": 53, "b": 24, "c": 23, "d": 1, "e": 0, "f": 200}
    parties = spark.createDataFrame([(k, float(v), 41) for k, v in votes.items()], "source string, votes double, n long")
    got = {r["source"]: r["seats"] for r in m.apportion(parties, [], "votes", "n", ["source"], "seats").collect()}
    seats = dict.fromkeys(votes, 0)
    for _ in range(41):
        k = max(seats, key=lambda k: (votes[k] / (2 * seats[k] + 1), -ord(k)))
        seats[k] += 1
    assert got == seats


def near_targets(got):
    """Every source within a word, or 2 percent, of its target; the bound of three times a document's size holds."""
    taken = defaultdict(int)
    for g in got:
        taken[g["source"]] += g["taken"]
        assert 0 <= g["taken"] <= 3 * g["size"]
    target = {g["source"]: g["target"] for g in got}
    assert all(abs(taken[k] - t) <= max(1, 0.02 * t) for k, t in target.items())
    return taken


def test_small_sources_come_near_their_targets(spark):
    rows = [(1, "w " * 100, "a"), (2, "x " * 900, "b"), (3, "y " * 60, "b"), (4, None, "c"), (5, " ", "c")]
    assert near_targets(m.mix(m.sized(docs(spark, rows))).collect())["c"] == 0
    rows = [(1, "w " * 40_000, "a"), (2, "x " * 5, "b"), (3, "x " * 2, "c"), (4, "x", "d"), (5, "y " * 11, "e")]
    assert near_targets(m.mix(m.sized(docs(spark, rows))).collect())["e"] == 33
    rows = [(k, "w " * 20, f"s{k:02}") for k in range(60)]
    assert sum(near_targets(m.mix(m.sized(docs(spark, rows))).collect()).values()) == 1200


def test_sources_of_one_to_200_words_beside_a_large_one(spark):
    sizes = spark.sql("select id doc_id, if(id < 5000, 'big', concat('s', id)) source, if(id < 5000, 600, id - 4999) size, id * 7919 % 100003 place from range(5200)")
    near_targets(m.mix(sizes, shard_words=100_000).collect())


def test_picks_by_hand(spark):
    # a ring of 10 words cut from word 7 on into blocks 7 8 9 | 0 1 2 | 3 4 5 and the tail 6
    ring = spark.sql("select id x, 7L turn, 10L ring, 3L unit, 3L blocks from range(10)")
    from pyspark.sql import functions as F

    for rest, want in ((0, []), (2, [7, 8]), (3, [3, 4, 5]), (5, [3, 4, 5, 7, 8]), (7, [0, 1, 2, 3, 4, 5, 7]), (9, [0, 1, 2, 3, 4, 5, 7, 8, 9])):
        at = ring.withColumn("rest", F.lit(rest).cast("long")).withColumn("picks", F.lit(rest // 3).cast("long"))
        for picked in (m.rest_before(F.col("x") + 1) > m.rest_before(F.col("x")), m.rest_takes(F.col("x"))):
            assert sorted(r.x for r in at.filter(picked).collect()) == want


def test_equal_rows_together(spark):
    rows = [(i // 4, "one two three four five " * 9, "a") for i in range(40)] + [(100, "z " * 700, "b")]
    got = m.mix(m.sized(docs(spark, rows))).collect()
    again = m.mix(m.sized(docs(spark, rows).repartition(3))).collect()
    key = lambda g: (g["doc_id"], g["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == 41
