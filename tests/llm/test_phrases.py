import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from partflow.llm import phrases as ph
from partflow.llm.common import packed, unpacked
from tests.helpers import SF, check

DOCS = "doc_id long, text string, lang string, source string, w1 string, key string, phrase string, rank string"


def docs(spark, rows):
    """rows: (text, lang)."""
    return spark.createDataFrame([(k % 3 or None, t, g, "s", "x", "x", "x", "x") for k, (t, g) in enumerate(rows)], DOCS)


def brute(rows, least=ph.MIN, share=ph.SHARE, top=ph.TOP):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, seen in f.items():
        cand = {p: a for p, a in seen.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= share * seen[p[i:j]]}
        rows = []
        for p, a in cand.items():
            if p not in gone:
                score, _, l, r = min((2_000_000 * a // (seen[p[:k]] + seen[p[k:]]), k, seen[p[:k]], seen[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(seed, n=150):
    x = random.Random(seed)
    vocabulary = ["the", "of", "É", "Word", "a", "ab", "b", *(f"w{k}" for k in range(40))]
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "!?", "\v"]
    out = []
    for _ in range(n):
        words = x.choices(vocabulary, [40, 30, 20, 10, 9, 8, 7, *[1] * 40], k=x.randrange(90))
        out.append(("".join(w + x.choice(marks) for w in words), x.choice(["en", "fr", None, "und"])))
    return [*out, *[("new york city hall is new york", "en")] * 40, ("", "en"), (None, "fr"), (" . ", None), ("one", "de"), ("a b " * 3000, "en"), ("z" * 5000 + " q", "en")]


@pytest.mark.parametrize(("seed", "hot", "chunk"), [(1, 256, 4_000_000), (2, 4, 300), (3, 10_000, 1000)])
def test_random_texts(spark, monkeypatch, seed, hot, chunk):
    monkeypatch.setattr(ph, "HOT", hot)
    monkeypatch.setattr(ph, "CHUNK", chunk)
    monkeypatch.setattr(ph, "BUCKET", 500)
    rows = corpus(seed)
    for least, top in ((ph.MIN, ph.TOP), (2, 15)):
        assert found(ph.collocations(docs(spark, rows).repartition(3), least, top=top)) == brute(rows, least, top=top)


def test_growth_is_depth_first():
    pointers = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 5, 0], [1, 3, 0, 0], [2, 3, 4, 0]]).T
    none = np.zeros(0, np.int64)
    got = ph.grow(pointers, np.array([1, 1, 5, 1, 2]), none, 2).tolist()
    assert got == [[1, 2, 0, 0, 7], [1, 2, 3, 0, 2], [1, 2, 3, 4, 2], [1, 2, 5, 0, 5], [2, 3, 0, 0, 2], [2, 3, 4, 0, 2]]
    assert [1, 3, 0, 0, 1] in ph.grow(pointers, np.array([1, 1, 5, 1, 2]), np.array([1, 3]), 2).tolist()
    rows = np.array([[5, -7, 2**31 - 1], [0, 1, 300]])
    assert (unpacked(packed(rows), 2) == rows).all() and unpacked(packed(rows[:, :0]), 2).shape == (2, 0)


def test_products_beyond_64_bits(spark):
    df = spark.sql("select 9000000000000000 a, 9000000000000001 l, 9000000000000002 r")
    assert df.selectExpr("(cast(a as decimal(24,0)) * 2000000) div (cast(l as decimal(24,0)) + cast(r as decimal(24,0))) s").first().s == 2_000_000 * 9 * 10**15 // (18 * 10**15 + 3)


def test_no_words(spark):
    assert ph.collocations(docs(spark, [])).count() == 0
    assert ph.collocations(docs(spark, [(None, "en"), ("", None), ("one two", "en")])).count() == 0


def test_same_as_sql(spark):
    check(ph.op11_phrases, ph.OP11_SQL, spark)
    check(ph.op11_phrases, ph.OP11_SQL, spark, SF.replace("0.001", "0.01"))


def test_supports_and_words_are_not_broadcast(spark):
    found = ph.collocations(docs(spark, [(" ".join(f"w{(k * 7 + j) % 50}" for j in range(60)), "en") for k in range(100)]))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 3
    assert found.count() > 0


def test_a_bucket_is_grown_in_little_memory():
    """A bucket's pointers take 28 bytes each while it is grown, and what is made of them a few times as much at most."""
    r = np.random.default_rng(1)
    rows = np.minimum(r.zipf(1.3, (5, 200_000)), 100_000).astype(np.int32)
    rows[4] = 1
    parts = [packed(rows[:, at : at + 5000]) for at in range(0, 200_000, 5000)]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["bucket", "pointers"])
    hot = np.arange(1, 200, dtype=np.int64)
    del rows, parts
    tracemalloc.start()
    try:
        got = list(ph._grown(hot, 30)([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == 1 and got[0].num_rows and peak < 80 * 200_000


def test_hot_words_are_told_apart():
    word = np.array([0, 1, 5, 7, 9, 2**31 - 1], np.int32)
    assert ph.is_hot(word, np.array([1, 7, 8])).tolist() == [False, True, False, True, False, False]
    assert not ph.is_hot(word, np.zeros(0, np.int64)).any()
