import glob

import numpy as np
import pyarrow as pa
import pytest

from partflow.llm import jaccard_join as j
from partflow.llm.common import likely, stored
from tests.llm.common import corpus, docs, words


def brute(rows, n, num, den):
    sets = {}
    for r in rows:
        w = words(r[1])
        sets[r[0]] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common * den >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("rule", [j.Rule(3, 90, 100), j.Rule(5, 80, 100, 2, 1), j.Rule(2, 60, 100, 4, 2)])
def test_equals_brute_force(spark, rule):
    rows = corpus(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.jaccard_classes(docs(spark, rows), rule).collect()}
    assert got == brute(rows, rule.n, rule.num, rule.den)


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(0)
    for rule in (j.Rule(3, 90, 100), j.Rule(5, 80, 100, 2, 1)):
        for _ in range(300):
            n = int(r.integers(1, 400))
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            b = a.copy()
            while True:
                keep = r.permutation(b)[: max(1, len(b) - int(r.integers(0, 3)))]
                c = np.unique(np.concatenate([keep, r.integers(0, 2**63, int(r.integers(0, 3))).astype(np.uint64)]))
                common = len(np.intersect1d(a, c))
                if common * rule.den < rule.num * (len(a) + len(c) - common):
                    break
                b = c
                if r.random() < 0.2:
                    break
            assert len(np.intersect1d(j.signatures(a, rule), j.signatures(b, rule)))


def test_sketch_never_exceeds_the_difference():
    r = np.random.default_rng(1)
    for _ in range(100):
        a, b = (np.unique(r.integers(0, 5000, int(r.integers(1, 3000))).astype(np.uint64)) for _ in range(2))
        x, y = j.sketch(a), j.sketch(b)
        both = pa.array([x, y], pa.list_(pa.int64()))
        size, lines = np.array([len(x), len(y)]), min(len(x), len(y))
        one, two = (j._fold(both, np.array([k]), size, lines) for k in (0, 1))
        bits = np.bitwise_count((one ^ two).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(a, b))


def test_null_and_repeated_ids(spark):
    rows = [(1, "a b c d e"), (1, "q r s t u"), (2, "q r s t u"), (None, "a b c d e"), (3, None), (4, "a b c d e")]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in j.jaccard_classes(docs(spark, rows)).collect())
    assert got == sorted([("1", 3, 1), ("1", 3, 1), ("2", 3, 1), ("None", 3, None), ("3", 0, 3), ("4", 3, 1)])
    assert j.jaccard_classes(docs(spark, [])).count() == 0


def test_a_doc_id_with_several_texts_joins_their_links(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "pq")
    rows = [(5, a), (5, b), (5, b), (6, a + " more"), (7, b + " more"), (7, ""), (8, "something else entirely here"), (8, None), (None, a)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in j.jaccard_classes(docs(spark, rows).repartition(3)).collect()}
    assert got == {(5, 38, 5), (6, 39, 5), (7, 39, 5), (7, 0, 5), (8, 2, 8), (8, 0, 8), (None, 38, None)}


@pytest.mark.parametrize("seed", [3, 4])
def test_random_repeated_ids_by_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(int(r.integers(0, 40)) if r.random() < 0.5 else 100 + k, x[1]) for k, x in enumerate(corpus(seed)) if len(x[1] or "") < 3000]
    one = brute([(k, t) for k, (_, t) in enumerate(rows)], 3, 90, 100)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, (i, _) in enumerate(rows):  # a document is linked with the class of each of its texts
        x, y = find(("set", one[k][1])), find(i)
        if one[k][0]:
            root[max(x, y, key=str)] = min(x, y, key=str)
    least = {}
    for i, _ in rows:
        least[find(i)] = min(i, least.get(find(i), i))
    want = sorted((i, one[k][0], least[find(i)]) for k, (i, _) in enumerate(rows))
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in j.jaccard_classes(docs(spark, rows)).collect())
    assert got == want


def test_large_groups_meet_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(j, "TILE", 5)
    monkeypatch.setattr(j, "FEW", 2)
    r = np.random.default_rng(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(60):  # one passage that all share, and as much of their own that some are near the limit
        own = [f"o{i // 2}x{k}" for k in range(int(r.integers(8, 30)))]
        rows.append((i, " ".join(base + own + [f"z{i}" for _ in range(int(r.integers(0, 4)))])))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in j.jaccard_classes(docs(spark, rows), j.Rule(5, 80, 100, 2, 1)).collect()}
    assert got == brute(rows, 5, 80, 100)


def test_pairs_of_a_group_by_brute_force():
    rule, r = j.Rule(5, 80, 100, 2, 1), np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 300, int(r.integers(5, 200))).astype(np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[3:], s[:1] + np.uint64(1000)])) for s in sets[:30]]
    side = r.integers(0, 2, len(sets))
    for two in (False, True):
        order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
        rows = [(7, 1, int(side[k]) if two else 0, k, k % 50, len(sets[k]), j.sketch(sets[k]).tolist()) for k in order]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = ["sig", "pair", "side", "node", "component", "n_shingles", "sketch"]
        cut = [pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows[at : at + 20]], kinds[c]) for c in range(7)], names=names) for at in range(0, len(rows), 20)]
        got = {(x["u"], x["v"]) for b in j._compare(rule)(iter(cut)) for x in b.to_pylist()}
        trees = [x for b in j._compare(rule, 0)(iter(cut)) for x in b.to_pylist()]
        tree, left = {(x["u"], x["v"]) for x in trees if x["u"] is not None}, [(x["sig"], x["pair"]) for x in trees if x["u"] is None]
        assert tree <= got and left == [(7, 1)] * (len(tree) < len(got))
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                both = len(np.intersect1d(sets[a], sets[b]))
                linked = both * 100 >= 80 * (len(sets[a]) + len(sets[b]) - both)
                met = a % 50 != b % 50 and (not two or side[a] != side[b])
                assert (a, b) in got if linked and met else (met or (a, b) not in got)
        assert len(got) > 5


def test_sets_without_elements_in_a_part_share_no_signature_for_it():
    rule, r = j.Rule(5, 80, 100, 2, 1), np.random.default_rng(11)
    sets = [np.unique(r.integers(0, 2**63, 120).astype(np.uint64)) for _ in range(400)]
    _, n = np.unique(np.concatenate([j.signatures(s, rule) for s in sets]), return_counts=True)
    assert (n * (n - 1) // 2).sum() < 10_000  # 60743 where an empty part is one signature for all, 7671 now
    for s in sets:  # a set less any one element, and with one more
        for t in (np.delete(s, int(r.integers(0, len(s)))), np.append(s, np.uint64(5))):
            assert len(np.intersect1d(j.signatures(s, rule), j.signatures(np.sort(t), rule)))


def test_documents_that_no_pair_wants_are_not_shuffled(spark):
    rows = docs(spark, [(k, f"text {k}") for k in range(3000)] + [(None, "none")])
    ids = spark.createDataFrame([(k,) for k in range(0, 3000, 50)], "doc_id bigint")
    got = {x.doc_id for x in likely(rows, ids, "doc_id").collect()}
    assert set(range(0, 3000, 50)) <= got and len(got) < 80
    assert likely(rows, ids.filter("doc_id < 0"), "doc_id").count() == 0


def test_what_was_shuffled_for_a_stored_table_goes(spark):
    def files():
        return {f for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}

    before = files()
    out = stored(spark.range(100_000).repartition(7, "id"), "cleared")
    assert not files() - before and out.count() == 100_000


def test_workers_forget_the_vocabularies_of_other_operators():
    import pyarrow as pa

    from partflow.llm import subwords as s
    from partflow.llm.token_files import tokenizer_path

    rule = j.Rule()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c d"])], names=["doc_id", "text"])
    for work in (j._nodes, j._named, j._signed, j._sets):
        s.subwords(tokenizer_path())
        assert s._LOADED
        assert sum(b.num_rows for b in work(rule)([batch])) and not s._LOADED, work


def test_settings_come_back(spark):
    from partflow.llm import common as c

    before = spark.conf.get(c.BATCH)
    with c.settings(spark, {c.BATCH: "7"}):
        assert spark.conf.get(c.BATCH) == "7"
    assert spark.conf.get(c.BATCH) == before


def _group(n, size, seed=0):
    """One signature's members, every third a near copy of the one before, all of different classes."""
    r = np.random.default_rng(seed)
    sets = [r.integers(0, 2**63, size).astype(np.uint64) for _ in range(n)]
    for k in range(1, n, 3):
        sets[k] = np.concatenate([sets[k - 1][: size * 95 // 100], sets[k][: size // 50]])
    sets = sorted((np.unique(s) for s in sets), key=len)
    cols = [np.zeros(n, np.int64)] * 3 + [np.arange(n)] * 2 + [np.array([len(s) for s in sets])]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([j.sketch(s) for s in sets], pa.list_(pa.int64()))], names=["sig", "pair", "side", "node", "component", "n_shingles", "sketch"])


def test_the_pairs_of_a_large_group_of_long_sets_are_not_held_at_once():
    """Their smallest sketches let all 79,800 pairs through: 170 MB where the larger ones of all are compared together."""
    import tracemalloc

    group = _group(400, 3000)
    for forest in (0, None):
        tracemalloc.start()
        n = sum(b.num_rows for b in j._compare(j.Rule(5, 80, 100, 2, 1), forest)(iter([group])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n >= 133 and peak < 80e6


def test_a_forest_of_runs_is_the_forest_of_all_pairs(monkeypatch):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 300).astype(np.uint64)
    sets = sorted((np.unique(np.concatenate([base, r.integers(0, 2**63, int(r.integers(0, 40))).astype(np.uint64)])) for _ in range(90)), key=len)
    cols = [np.zeros(90, np.int64)] * 3 + [np.arange(90), np.arange(90) % 70, np.array([len(s) for s in sets])]
    group = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([j.sketch(s) for s in sets], pa.list_(pa.int64()))], names=["sig", "pair", "side", "node", "component", "n_shingles", "sketch"])
    rule, got = j.Rule(5, 80, 100, 2, 1), []
    for most in (500_000, 100):
        monkeypatch.setattr(j, "AT_ONCE", most)
        got.append([{(x["u"], x["v"], x["sig"]) for b in j._compare(rule, forest)(iter([group])) for x in b.to_pylist()} for forest in (0, None)])
    assert got[0] == got[1] and len(got[0][0]) == 70 and len(got[0][1]) > 1000  # 69 edges and the group's name
