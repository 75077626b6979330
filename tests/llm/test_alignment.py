import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from partflow.llm import alignment as al
from tests.helpers import SF
from tests.llm.common import corpus, docs

A, B = al.tokenizer_path("byte_bpe_50k.json"), al.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    """Tokens of a text by both libraries as (ids, bytes), without segments."""
    tool = al.Aligner(A, B)

    def run(text):
        a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
        return [(i, tool.a_bytes[i]) for i in a], [(i, tool.b_bytes[i]) for i in b]

    return run


def brute(tokens, rows):
    seen, made = Counter(), []
    for i, text, *_ in rows:
        a, b = tokens(text) if text else ([], [])
        if not text or not b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + text).encode():
            made.append((i, 0, 0, 0, [], ""))
            continue
        links, groups, p, q, at, bt, j = [], [], [], [], 0, 0, 0
        spans_b = []
        for k, t in b:
            spans_b.append((bt, bt + len(t), k))
            bt += len(t)
        ends_b, done = {e for _, e, _ in spans_b}, 0
        for k, t in a:
            while j and spans_b[j][0] > at:
                j -= 1
            while spans_b[j][1] <= at:
                j += 1
            m = j
            while m < len(spans_b) and spans_b[m][0] < at + len(t):
                links.append((k, spans_b[m][2]))
                m += 1
            at += len(t)
            p.append(str(k))
            if at in ends_b:
                while done < len(spans_b) and spans_b[done][1] <= at:
                    q.append(str(spans_b[done][2]))
                    done += 1
                groups.append(",".join(p) + "|" + ",".join(q))
                p, q = [], []
        seen.update(links)
        made.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, y), n in seen.items():
        top[y] = max(top[y], n)
    return sorted((str(i), x, y, g, len(ln), sum(seen[p] == top[p[1]] for p in ln), sum(seen[p] for p in ln), h) for i, x, y, g, ln, h in made), seen


def found(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_groups_by_hand():
    # bytes: A 2 1 3, B 1 2 1 2; common ends 3, 6 (and a second text of one token each)
    ids = np.array([10, 11, 12, 13]), np.array([20, 21, 22, 23, 24])
    text, begin, links, groups, n = al.align(*ids, np.array([3, 1]), np.array([4, 1]), np.array([2, 1, 3, 4]), np.array([1, 2, 1, 2, 4]))
    assert text == b"10,11|20,21;12|22,23;13|24;" and begin.tolist() == [0, 21, 27] and groups.tolist() == [2, 1] and n.tolist() == [5, 1]
    assert [(x >> 32, x & 0xFFFF) for x in links.tolist()] == [(10, 20), (10, 21), (11, 21), (12, 22), (12, 23), (13, 24)]


def test_awkward_texts(spark, tokens, monkeypatch):
    x = random.Random(6)
    parts = [*"aab cde'stm  \n\t<|>19éȨ́ΣİIß!?.字　  🙂", "<|endoftext|>", "<0x41>", "</s>", "the", " of", "\0", "\x85", " \n ", "'s", "🙂🙃"]
    rows = [(i, "".join(x.choices(parts, k=x.randrange(60)))) for i in range(800)]
    rows += [(9000, "a ▁b"), (9001, "▁"), (9002, "x▁ y"), (9003, " "), (9004, "  "), (9005, "\n"), (None, "no id"), (None, "no id"), (5, "twice"), (5, "twice"), (9006, "z" * 30_000)]
    rows += [r[:2] for r in corpus(4)]
    monkeypatch.setattr(al, "CHUNK", 5_000)
    want, seen = brute(tokens, rows)
    got, totals = al.align_texts(docs(spark, rows).repartition(3), A, B)
    assert found(got) == want
    assert {(r.a, r.b): r.total for r in totals.collect()} == dict(seen)


def test_the_memory_is_emptied(tokens, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(al, "ROOM", 1000)
    tool = al.Aligner(A, B)
    texts = [r[1] or "" for r in corpus(9)]
    sizes = []
    for _ in range(2):
        of, edge = tool.segments(pa.array(texts, pa.string()))
        counts = tool.arrays()[0]
        sizes.append([int(counts[of[i:j], 0].sum()) for i, j in zip(edge[:-1], edge[1:])])
    assert sizes[0] == sizes[1] == [len(tokens(t)[0]) if t else 0 for t in texts]


def test_empty_tables(spark):
    got, totals = al.align_texts(docs(spark, []), A, B)
    assert got.count() == 0 and totals.count() == 0
    assert found(al.align_texts(docs(spark, [(1, None), (2, "")]), A, B)[0]) == [("1", 0, 0, 0, 0, 0, 0, ""), ("2", 0, 0, 0, 0, 0, 0, "")]


def test_the_whole_table(spark, tokens):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(al.op12_alignment(spark, SF)) == brute(tokens, rows)[0]
