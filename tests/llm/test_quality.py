from partflow.llm import quality as q
from tests.helpers import SF, connect
from tests.llm.common import docs, same_as_sql


def test_equals_sql(spark):
    same_as_sql(q.op3_quality, q.OP3_SQL, spark)


def test_held_out_accuracy(spark):
    """Fitted on the labels of even ids, judged on the odd ones."""
    sf = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r.keep for r in q.posteriors(spark.read.parquet(f"{sf}/documents.parquet"), labels.filter("doc_id % 2 = 0")).collect()}
    truth = connect(sf).sql("SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 1").fetchall()
    good = [got[i] for i, y in truth if y]
    bad = [got[i] for i, y in truth if not y]
    assert sum(good) / len(good) >= 0.97 and sum(bad) / len(bad) <= 0.25


def test_odd_rows(spark):
    clean = "The house stands by the river and people come there to rest in summer."
    rows = [(i, clean + f" Number {i}.", "a") for i in range(20)] + [(100 + i, "BUY!! *** NOW!! ### $$$ &&& %%% !!", "b") for i in range(20)] + [(200, None, None), (201, "", "a"), (None, clean, "a"), (1, clean, "a")]
    labels = spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in rows[:40]] + [(None, 1, 0), (3, None, 0), (999, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    frame = docs(spark, rows)
    out = q.posteriors(frame, labels).collect()
    assert len(out) == len(rows) and all(r.keep for r in out if r.doc_id is not None and r.doc_id < 100) and not any(r.keep for r in out if r.doc_id is not None and 100 <= r.doc_id < 200)
    kept = q.keep_good(frame, labels)
    assert kept.columns == frame.columns and kept.filter("doc_id is null").count() == 1
    empty = spark.createDataFrame([], labels.schema)
    assert all(r.keep for r in q.posteriors(frame, empty).collect()) and q.posteriors(docs(spark, []), labels).count() == 0
