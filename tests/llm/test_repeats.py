import hashlib
import random
from collections import Counter

import pytest

from partflow.llm import repeats as r
from tests.llm.common import corpus, docs


def brute(rows, length):
    seen, out = Counter(), []
    for _, text, *_ in rows:
        b = (text or "").encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((str(i), len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return sorted(out)


def found(spark, rows, length, gram):
    return sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in r.find_repeats(docs(spark, rows).repartition(3), length, gram).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_small_alphabet(spark, seed):
    x = random.Random(seed)
    source = "".join(x.choice("ab ") for _ in range(2500))
    rows = []
    for i in range(50):
        t = "".join(x.choice("ab ") for _ in range(x.randrange(0, 150)))
        for _ in range(x.randrange(0, 3)):
            a = x.randrange(0, 2400)
            t += source[a : a + x.randrange(10, 100)] + x.choice(["", "x", "é"])
        rows.append((i, t))
    rows += [(60, None), (61, ""), (62, "a" * 500), (63, rows[3][1]), (64, rows[3][1]), (65, "ab" * 200), (3, rows[3][1]), (None, rows[4][1]), (None, rows[4][1])]
    assert found(spark, rows, 40, 8) == brute(rows, 40)


def test_corpus_at_full_length(spark):
    rows = corpus(5)
    assert found(spark, rows, r.LENGTH, r.GRAM) == brute(rows, r.LENGTH)
    out = r.find_repeats(docs(spark, rows), texts=True).filter("n_removed > 0").first()
    assert out and len(out.kept_text) == out.n_bytes - out.n_removed
    assert r.find_repeats(docs(spark, [])).count() == 0


def test_texts_whose_polynomial_hashes_agree_lose_nothing(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64, whatever the base."""
    g = "gqosaauth igfjergijsyi vozzfrlpndygsmgjzdzadsxarjvyxuecqlszjnqvlyqkadowoljrmkzxvspdummgraiutxx xqgot qnxwjwfotvqglqavmsnmktsxwxc"
    odd = [bin(i).count("1") % 2 for i in range(128)]
    x, y = "".join(("ht", "mj")[s] for s in odd), "".join(("mj", "ht")[s] for s in odd)
    rows = [(1, x + g + y), (2, y + g + x)]
    assert found(spark, rows, r.LENGTH, r.GRAM) == brute(rows, r.LENGTH) and all(t[2] == 0 for t in brute(rows, r.LENGTH))


def test_the_whole_table_by_brute_force(spark):
    from tests.helpers import SF

    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(x.doc_id, x.text) for x in d.collect()]
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in r.op4_repeated_passages(spark, SF).collect())
    assert got == brute(rows, r.LENGTH) and any(x[2] for x in got)
