import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partflow.llm import token_files as t
from partflow.llm.common import scratch
from partflow.llm.subwords import subwords
from tests.llm.common import corpus, docs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**16), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 40))
def test_coding_round_trip(values, block):
    v = np.array(values, np.uint64)
    coded = t.encode_ids(v, block)
    assert (t.decode_ids(len(v), *coded, block) == v).all()
    if len(v) > 2 * block:
        assert (t.decode_ids(len(v), *coded, block, slice(1, 2)) == v[block : 2 * block]).all()


def test_zero_runs_and_escapes():
    v = np.array([0] * 5000 + [2**60] + [7] * 100 + [2**64 - 1], np.uint64)
    first, words, escapes = t.encode_ids(v)
    assert len(words) < 60 and escapes.tolist() == [2**60, 2**64 - 1]
    assert (t.decode_ids(len(v), first, words, escapes) == v).all()
    ids, counts, back = t.unpack_segment(t.pack_segment([5, None], [5000, 102], v))
    assert ids == [5, None] and counts.tolist() == [5000, 102] and (back == v).all()
    with pytest.raises(ValueError):
        t.unpack_segment(b"x" * 64)


def test_subwords_equal_the_tokenizer():
    s = subwords(t.tokenizer_path())
    odd = ["a  b", "a \nb", " x", "  x", "a\n b", "a\n  b", "x ", "x\n", "", "  ", "don't 's", "<|endoftext|> a<|endoftext|>", "a　 b", "a   b", "é  b", "\0 a"]
    odd += [x[1] or "" for x in corpus()]
    assert s.encode(odd) == s._raw(odd)


def test_files_hold_every_document(spark):
    from tokenizers import Tokenizer

    rows = [*corpus(), (3, "again", "a"), (None, "no id", "a")]
    got = t.read_token_files(t.write_token_files(docs(spark, rows), scratch(spark, "t"), t.tokenizer_path())).collect()
    tok = Tokenizer.from_file(t.tokenizer_path())
    start, want = 0, []
    for i, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(a), b, c) for a, b, c in want)
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) == start
    by_start = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert by_start[0] is None and by_start[1:] == sorted(by_start[1:])
    assert t.read_token_files(t.write_token_files(docs(spark, []), scratch(spark, "t"), t.tokenizer_path())).count() == 0
