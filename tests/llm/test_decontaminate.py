import numpy as np

from partflow.llm import decontaminate as d
from tests.llm.common import corpus, docs, words

ITEMS = [(1, "what colour is the old house by the river bank\nit is red and rather small"), (2, "name the largest animal that ever lived on this planet"), (3, None), (4, ""), (5, "short"), (2, "name the largest animal that ever lived on this planet"), (None, "no id here")]


def test_wand_equals_exhaustive_scores():
    r = np.random.default_rng(0)
    index = d.ItemIndex([(i, " ".join(f"w{int(x)}" for x in np.minimum(r.zipf(1.3, int(r.integers(5, 60))), 400))) for i in range(150)])
    for k in range(200):
        q = np.unique(r.choice(len(index.terms), int(r.integers(1, 60))))
        if k % 2:
            item = int(r.integers(0, 150))
            mine = np.array([t for t in range(len(index.terms)) if item in index.item[index.start[t] : index.start[t + 1]]])
            q = np.unique(np.concatenate([mine[r.random(len(mine)) < 0.8], q[:5]]))
        s = np.zeros(150)
        for t in q:
            s[index.item[index.start[t] : index.start[t + 1]]] += index.weight[index.start[t] : index.start[t + 1]]
        got = dict(index.wand(q.astype(np.int64)))
        assert set(got) == {i for i in range(150) if s[i] >= d.THETA - 1e-9}
        assert all(abs(got[i] - s[i]) < 1e-9 for i in got)
        for i in got:  # the first test lets every hit through
            assert len(index.candidates(q.astype(np.int64), np.zeros(len(q), np.int64), 1)) == 1


def test_leaks_are_found_and_others_left(spark):
    rows = [(i, t) for i, t, *_ in corpus(4)]
    one, two = ITEMS[0][1], ITEMS[1][1]
    long = rows[10][1] + " " + " ".join(f"filler{k}" for k in range(500))
    rows += [(2000, long + " " + one.upper() + " " + long), (2001, two), (2002, "the old house by the river"), (2003, one.split("\n")[0] + " and nothing of the answer"), (2000, "clean text"), (None, two)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for shard in (d.SHARD_WORDS, 12):
        got = sorted((str(r.doc_id), r.item_id) for r in d.leaks(docs(spark, rows), items, shard).collect())
        assert got == sorted([("2000", 1), ("2001", 2), ("2001", 2), ("None", 2), ("None", 2)])
    kept = d.drop_leaks(docs(spark, rows), items)
    assert "clean text" not in {r.text for r in kept.collect()} and kept.columns == docs(spark, []).columns
    assert d.leaks(docs(spark, rows), items.limit(0)).count() == 0 and d.leaks(docs(spark, []), items).count() == 0


def test_every_planted_item_by_brute_force(spark):
    from tests.helpers import SF, connect

    sf = SF.replace("0.001", "0.01")
    c = connect(sf)
    items, texts = c.sql("SELECT item_id, text FROM benchmark").fetchall(), c.sql("SELECT doc_id, text FROM documents").fetchall()

    def grams(t):
        w = words(t)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    of = {i: grams(t) for i, t in items}
    want = {(i, k) for i, t in texts for k, g in of.items() if g and len(g & grams(t)) >= 0.9 * len(g)}
    got = {(r.doc_id, r.item_id) for r in d.op10_decontaminate(spark, sf).collect()}
    assert want and want <= got and len(got - want) <= 1


def test_short_answers_glued_to_other_text():
    import pyarrow as pa

    from partflow.llm.common import flat

    question = " ".join(f"ask{k}" for k in range(12))
    index = d.ItemIndex([(1, f"{question}\nred"), (2, f"{question.upper()[::-1]}\nit is quite small today"), *((k, f"other{k} item{k} number{k}") for k in range(3, 9))])
    one, two = f"before {question} red", f"before {question.upper()[::-1]} it is quite small today"
    texts = [one + ".%%%", one + "?", two + ".&&& after", two + "Next", "before (" + two[7:], one[:-3] + "green", two[: -len("it is quite small today")] + "nothing like that at all", "%%% &&& .", ""]
    assert {(r, index.ids[item]) for r, item, *_ in d.find_leaks(index, *flat(pa.array(texts)))} == {(0, 1), (1, 1), (2, 2), (3, 2), (4, 2)}


def test_bare_words():
    def of(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return d.bare_words(raw, np.array([0, len(raw)]))[0].tolist()

    assert of("(One) two.%% é\u00e9!! --- a-b 'x") == of("one two é\u00e9 --- a-b x") and len(of("... !")) == 2 and of("...") != of("!") and of("") == []


def test_every_planted_item_of_the_larger_table(spark):
    from tests.helpers import SF, connect

    sf = SF.replace("0.001", "0.1")
    c = connect(sf)

    def grams(t):
        w = words(t)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    of = {i: grams(t) for i, t in c.sql("SELECT item_id, text FROM benchmark").fetchall()}
    items_with = {}
    for i, g in of.items():
        for x in g:
            items_with.setdefault(x, []).append(i)
    want = set()
    for i, t in c.sql("SELECT doc_id, text FROM documents").fetchall():
        held = [k for x in grams(t) for k in items_with.get(x, ())]
        want |= {(i, k) for k in set(held) if held.count(k) >= 0.9 * len(of[k])}
    got = {(r.doc_id, r.item_id) for r in d.op10_decontaminate(spark, sf).collect()}
    assert len(want) > 200 and want <= got and len(got - want) <= 1
