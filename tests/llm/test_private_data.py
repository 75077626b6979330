import hashlib
import re

from partflow.llm import pii
from tests.llm.common import docs, same_as_sql
from tests.helpers import SF, connect

ODD = ["a@b.c@d.e x%y@z.w", "1.2.3.4.5.6.7.8 001.002.0255.4 256.1.1.1", "4111 1111 1111 1111x 4111-1111-1111-1112 5", "+1 (555) 123-4567. +49 30 123456) +1", "é@a.b 😀 x@y.zz", "", None, "a" * 50000 + "@b.c", "1" * 3000, "x@y" + ".a" * 20000, "+1" + " 2" * 3000, "4111111111111111 4111111111111111"]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind in pii.KINDS:
        for m in re.finditer(pii.PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def agree(got, texts):
    for i, text in texts:
        want = base(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[i].spans.split(",")[: len(want)] == want or not want
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]


def test_base_spans(spark):
    agree({r.doc_id: r for r in pii.digests(pii.find_private(docs(spark, list(enumerate(ODD))))).collect()}, list(enumerate(ODD)))


def test_whole_table(spark):
    agree({r.doc_id: r for r in pii.op2_private_data(spark, SF).collect()}, connect().sql("SELECT doc_id, text FROM documents").fetchall())


def test_equals_sql(spark):
    same_as_sql(pii.op2_private_data, pii.OP2_SQL, spark)


def test_disclosing_terms(spark):
    rows = []
    for i in range(40):
        who = "captain zorblax" if i < 6 else "captain smith"
        rows.append((i, f"Text number {i} says {who} wrote {'secret@mail.example.com' if i < 6 else 'nothing here'} to us about topic{i} and more words {i * 7}"))
    got = {r.doc_id: r for r in pii.digests(pii.find_private(docs(spark, rows))).collect()}
    for i, text in rows:
        at = text.find("zorblax")
        want = base(text) + ([f"remove:{at}:{at + 7}"] if i < 6 else [])
        assert got[i].spans == ",".join(want)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows)).collect()}
    assert "zorblax" not in clean[0] and "[EMAIL]" in clean[0] and "captain" in clean[0] and clean[30] == rows[30][1]
    copies = [(i, rows[0][1]) for i in range(30)] + [(100 + i, "other words entirely") for i in range(30)]
    assert all("remove" not in r.spans for r in pii.digests(pii.find_private(docs(spark, copies))).collect())


def test_repeated_null_and_empty(spark):
    rows = [(1, "a@b.c"), (1, "a@b.c"), (None, "x 1.2.3.4"), (2, None)]
    got = sorted((str(r.doc_id), r.spans) for r in pii.digests(pii.find_private(docs(spark, rows))).collect())
    assert got == [("1", "email:0:5"), ("1", "email:0:5"), ("2", ""), ("None", "ip:2:9")]
    assert pii.digests(pii.find_private(docs(spark, []))).count() == 0


def rich(n=60):
    """Texts in which terms foretell entities, some of them behind long words and more than 200 characters away."""
    rows = []
    for i in range(n):
        kind = i % 4
        who = ["captain zorblax", "doctor quimby", "plain person", "plain person"][kind]
        to = ["secret@mail.example.com", "+1 555 123 45" + "67", "nothing", "10.0.0." + str(i)][kind]
        rows.append((i, f"Text number {i} says ({who}) {'w' * 240}{i} wrote:{to} {'v' * 300} to us about topic{i % 7} and more words {i * 7}"))
    return [*rows, (None, rows[0][1] + " again"), (3, rows[1][1]), (4, None), (5, "")]


def test_added_spans_equal_sql(spark, tmp_path):
    from tests.helpers import check

    docs(spark, rich()).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    for f in tmp_path.glob("documents.parquet/[._]*"):
        f.unlink()
    check(pii.op2_private_data, pii.OP2_SQL, spark, str(tmp_path))
    got = {r.doc_id: r.spans for r in pii.digests(pii.find_private(docs(spark, rich()))).collect()}
    at = rich()[0][1].find("zorblax")
    assert f"remove:{at}:{at + 8}" in got[0] and any("generalise" in x or "remove" in x for x in got.values())


def test_very_many_matches(spark):
    text = " ".join(str(k % 90 + 10) + "," for k in range(15_000)) + " a@b.c 4111111111111111"
    agree({r.doc_id: r for r in pii.digests(pii.find_private(docs(spark, [(1, text)]))).collect()}, [(1, text)])
