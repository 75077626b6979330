"""The pipeline against its stages done by hand."""

import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as c
from partflow.llm import decontaminate, mixing, quality
from partflow.llm.common import stored, table
from partflow.llm.token_files import tokenizer_path
from tests.helpers import SF
from tests.llm.common import corpus, docs, words
from tests.llm.test_jaccard_join import brute
from tests.llm.test_mixing import targets


def in_order(part, whole):
    """The words of `part` stand in `whole` in this order."""
    rest = iter(whole)
    return all(w in rest for w in part)


def by_hand(rows):
    """Texts that the mix takes of (doc_id, text, source): every source's share, shards, places and picked blocks step by step."""
    import hashlib

    def unit(*parts):
        return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:15], 16)

    def seats(votes, n):
        """Highest quotients; ties to the first."""
        out = [0] * len(votes)
        for _ in range(n if any(votes) else 0):
            out[max(range(len(votes)), key=lambda k: (votes[k] / (2 * out[k] + 1), -k))] += 1
        return out

    sizes, lines = Counter(), {}
    for i, text, source in rows:
        w = re.findall(mixing.WORD, text or "")
        sizes[source] += len(w)
        place = unit(str(mixing.SEED), "-" if i is None else str(i), hashlib.md5((text or "").encode()).hexdigest())
        lines.setdefault(source, []).append((place, -1 if i is None else i, text or "", w))
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets(sizes)
    granted = seats([float(want[s]) for s in sources], round(float(sum(want.values()))))
    out = []
    for source, quota in zip(sources, granted, strict=True):
        n = sizes[source]
        assert n <= mixing.SHARD_WORDS  # one shard
        if not n:
            continue
        passes, rest = divmod(min(quota, mixing.CEILING * n), n)
        turn = unit(str(mixing.SEED), source or "", "0") % n
        blocks = n // mixing.BLOCK
        picks = min(blocks, rest // mixing.BLOCK)
        short = rest - picks * mixing.BLOCK
        chosen = [j for j in range(blocks) if (j + 1) * picks // blocks > j * picks // blocks]
        from_turn = {j * mixing.BLOCK + k for j in chosen for k in range(mixing.BLOCK)}
        from_turn |= {k + (0 if picks < blocks else blocks * mixing.BLOCK) for k in range(short)}
        assert len(from_turn) == rest
        ring = {(turn + y) % n for y in from_turn}
        at = 0
        for _, i, text, w in sorted(lines[source], key=lambda x: x[:2]):
            picked = [x for k, x in enumerate(w) if at + k in ring]
            at += len(w)
            out += [(i, text)] * (passes if w else 0)
            if picked:
                out.append((i, text if len(picked) == len(w) else " ".join(picked)))
    return sorted(out)


def odd_rows():
    rows = [r for r in corpus(5) if r[0] != 905]
    return [*rows, rows[0], rows[0], rows[1], (None, "no id at all", "b"), (None, "no id at all", "b"), (903, "another text of one id", "a"), (700, "x " * 3000, "b"), (700, "x " * 3000, "b")]


def test_mixed_texts_by_hand(spark):
    rows = odd_rows()
    got = c.mix_sources(spark, docs(spark, rows).repartition(5), SF)
    assert got.columns == docs(spark, rows).columns
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in got.collect())
    assert got == by_hand(rows)
    taken = sum(r["taken"] for r in mixing.mix(mixing.sized(docs(spark, rows))).collect())
    assert sum(len(words(t)) for _, t in got) == taken
    assert c.mix_sources(spark, docs(spark, []), SF).count() == 0


def test_odd_rows_through_all_stages(spark):
    frame = docs(spark, odd_rows())
    for name, stage in c.STAGES:
        out = stored(stage(spark, frame, SF), "odd")
        if name != "tokens":
            assert out.columns == frame.columns
            frame = out
    assert out.count() == frame.count()
    empty = docs(spark, [])
    for _, stage in c.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    keep = {r.doc_id for r in quality.posteriors(docs, table(spark, SF, "labels")).collect() if r.keep}
    stages = dict(c.STAGES)
    a = stored(stages["quality"](spark, docs, SF), "a")
    assert a.columns == columns and {r.doc_id for r in a.collect()} == keep

    classes = brute([(i, rows[i]) for i in keep], 5, 80, 100)
    b = stored(stages["near_copies"](spark, a, SF), "b")
    left = {i for i in keep if classes[i][1] == i}
    assert b.columns == columns and {r.doc_id for r in b.collect()} == left and len(left) < len(keep)

    leaked = {r.doc_id for r in decontaminate.leaks(b, table(spark, SF, "benchmark")).collect()}
    d = stored(stages["decontamination"](spark, b, SF), "d")
    assert d.columns == columns and {r.doc_id for r in d.collect()} == left - leaked

    taken = {r.doc_id: r.taken for r in mixing.mix(mixing.sized(d)).collect()}
    e = stored(stages["mixing"](spark, d, SF), "e")
    got = Counter()
    for r in e.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text) and (r.text == rows[r.doc_id] or in_order(words(r.text), words(rows[r.doc_id])))
    assert e.columns == columns and got == Counter({i: n for i, n in taken.items() if n})

    tok = Tokenizer.from_file(tokenizer_path())
    want = sorted((r.doc_id, zlib.crc32(np.array(tok.encode(r.text, add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in e.collect())
    assert sorted((r.doc_id, r.ids_crc32) for r in stages["tokens"](spark, e, SF).collect()) == want
    assert c.ORACLE_SQL is None and sorted((r.doc_id, r.ids_crc32) for r in c.run(spark, SF).collect()) == want
