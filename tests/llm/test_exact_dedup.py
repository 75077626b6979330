import hashlib
import random

from partflow.llm import exact_dedup as e
from tests.llm.common import corpus, docs, same_as_sql


def test_cuckoo_index_against_a_dict():
    r = random.Random(1)
    index, live = e.CuckooIndex(4), {}
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for _ in range(12000):
        k = r.choice(keys)
        if k in live and r.random() < 0.5:
            assert index.delete(k)
            del live[k]
        elif k not in live:
            index.insert(k, len(live))
            live[k] = index.find(k)
    assert dict(index.items()) == live and index.size == len(live) and index.resizes > 3
    assert all(index.may_contain(k) for k in live) and not index.delete(b"\0" * 32)
    assert all(index.find(k) is None for k in keys if k not in live)


def test_colliding_fingerprints_are_told_apart():
    index = e.CuckooIndex(2)
    keys = [b"ab" + b"\1" * 8 + bytes([k]) * 22 for k in range(8)]
    for k in keys:
        index.insert(k, k[10])
    assert [index.find(k) for k in keys] == list(range(8)) and index.find(b"ab" + b"\1" * 8 + b"\x09" * 22) is None


def test_equals_sql(spark):
    same_as_sql(e.op6_exact_dedup, e.OP6_SQL, spark)


def test_odd_rows_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(e, "CHUNK", 7)
    rows = [*corpus(), *[(1000 + i, "hot", "a") for i in range(100)], (5, "same", "a"), (5, "same", "a"), (None, "n", "a"), (None, "n", "a"), (None, "hot", "b")]
    got = e.exact_dedup(docs(spark, rows).repartition(6)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    assert len(got) == len(rows)
    for text, ids in groups.items():
        mine = [g for g in got if g.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert {(g.keep_id, g.group_size) for g in mine} == {(keep, len(ids))}
        assert [g.doc_id for g in mine if g.kept] == [keep]
    assert e.exact_dedup(docs(spark, [])).count() == 0


def state(index):
    named = {hashlib.sha256(t.encode()).digest(): t for t in ("a", "b", "c", "h", "")}
    return {(named[bytes(r.digest)], r.keep, r.n) for r in e.live_groups(index).collect()}


def test_changes_to_a_live_index(spark):
    index = e.live_index(docs(spark, [(1, "a"), (2, "a"), (3, "b")]))
    out = e.apply_changes(index, docs(spark, [(4, "c"), (9, "a")]), docs(spark, [(3, "b"), (1, "a")]))
    assert state(out) == {("a", 9, 2), ("c", 4, 1)}


def test_keep_follows_deletions(spark, monkeypatch):
    monkeypatch.setattr(e, "CHUNK", 3)
    index = e.live_index(docs(spark, [(1, "h"), (9, "h")]))
    assert state(e.apply_changes(index, docs(spark, []), docs(spark, [(9, "h"), (77, "h"), (5, "a")]))) == {("h", 1, 1)}
    r = random.Random(4)
    live, index = [], e.live_index(docs(spark, []))
    for _ in range(3):
        came = [(r.choice([None, *range(8)]), r.choice(["a", "b", "h", None])) for _ in range(40)]
        went = r.sample(live + came, 20) + [(99, "a")]
        index = e.apply_changes(index, docs(spark, came), docs(spark, went).repartition(3))
        live = live + came
        for x in went[:-1]:
            live.remove(x)
        want = set()
        for t in {x[1] or "" for x in live}:
            ids = [i for i, y in live if (y or "") == t]
            want.add((t, max((i for i in ids if i is not None), default=None), len(ids)))
        assert state(index) == want
