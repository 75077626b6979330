"""Fixtures with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, k string, size string, word string"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or ""), "x", "x", "x", "x") for r in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed=0, n=60):
    """Random texts with exact copies, near copies, shared passages and odd rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randrange(2, 7))) for _ in range(400)]

    def text(k):
        return " ".join(r.choice(vocabulary).capitalize() if r.random() < 0.1 else r.choice(vocabulary) for _ in range(k))

    out = [(i, text(r.randrange(1, 120)), r.choice(["a", "b", "b", None])) for i in range(n)]
    for i in range(n, n + 15):
        base = r.choice(out)[1]
        kind = r.randrange(3)
        if kind == 0:
            out.append((i, base, "a"))
        else:
            w = base.split(" ")
            w[r.randrange(len(w))] = "changed"
            out.append((i, " ".join(w) if kind == 1 else base + " " + text(3), "b"))
    passage = text(140)
    out += [(n + 20 + i, text(20) + " " + passage + "\n" + text(10), "a") for i in range(4)]
    return [*out, (900, None, None), (901, "", "a"), (902, " \n\t", "b"), (903, "Word", "b"), (904, "word", "b"), (905, text(4000), "a"), (906, "a b", None), (907, "A B", None)]


def same_as_sql(query, sql, spark):
    from tests.helpers import check

    check(query, sql, spark)
