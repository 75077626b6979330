import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from partflow.llm import word_bpe as w
from tests.helpers import SF
from tests.llm.common import corpus, docs

PATH = w.tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def theirs(tokenizer, texts):
    return [(e.ids, tokenizer.decode(e.ids, skip_special_tokens=False)) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    coder = w.word_bpe(PATH)
    ids, counts = coder.encode_column(pa.array(texts, pa.string()))
    edge = np.concatenate([[0], np.cumsum(counts)])
    return [(ids[i:j].tolist(), bytes(d).decode()) for i, j, d in zip(edge[:-1], edge[1:], coder.decode(ids, counts), strict=True)]


def test_any_character(tokenizer):
    x = random.Random(3)
    letters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b" for c in x.sample(letters, 40_000)] + ["".join(x.choices(letters, k=30)) for _ in range(500)]
    assert ours(texts) == theirs(tokenizer, texts)


def test_odd_texts(tokenizer):
    x = random.Random(4)
    parts = [*"aaaabbcde'stmvl  \n\t<|>1٣éȨ́́ΣσİIß!?.字　  ​🙂", "<|endoftext|>", "<|startoftext|>", "<|end", "'s", "'LL", "\0", "\x85", "\x1c"]
    texts = ["".join(x.choices(parts, k=x.randrange(200))) for _ in range(3000)] + ["", " ", "\n\t"]
    assert ours(texts) == theirs(tokenizer, texts)


def test_long_words_are_swept(tokenizer):
    x = random.Random(5)
    texts = ["".join(x.choices(a, k=k)) for a in ("ab", "a", "aé", "the", "abcdefghijklmnopqrstuvwxyz", "!?-") for k in (w.LONG - 1, w.LONG, 1500, 100_000)]
    assert ours(texts) == theirs(tokenizer, texts)


def test_the_memory_is_emptied(tokenizer, monkeypatch):
    monkeypatch.setattr(w, "ROOM", 1000)
    texts = [r[1] or "" for r in corpus(9)]
    for _ in range(3):
        assert ours(texts) == theirs(tokenizer, texts)


def brute(tokenizer, rows):
    out = []
    for i, text, *_ in rows:
        (ids, decoded), = theirs(tokenizer, [text or ""])
        out.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out)


def test_awkward_rows(spark, tokenizer):
    rows = [*corpus(2), (3, "again <|endoftext|>", "a"), (None, "no id", "a"), (None, "no id", "a")]
    d = docs(spark, rows).repartition(3)
    got = w.encode_texts(d, PATH, texts=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == brute(tokenizer, rows)
    assert all(len(r.ids) == r.n_tokens and hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in got)
    assert w.encode_texts(docs(spark, []), PATH).count() == 0


def test_the_whole_table(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = w.op13_word_bpe(spark, SF).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == brute(tokenizer, rows)
