from partflow.llm import line_dedup as l
from tests.llm.common import same_as_sql


def test_equals_sql(spark):
    same_as_sql(l.op9_line_dedup, l.OP9_SQL, spark)


def test_boilerplate_goes(spark):
    nav = "<nav><a href='/'>Home page</a></nav><script>x='</p>'</script>"
    rows = [(i, f"http://A.example/{i}", f"<html>{nav}<p>Own line {i} &amp; more</p><p>Own line {i} &amp; more</p><!-- no --></html>") for i in range(6)]
    rows += [(10, "http://b.example/", f"{nav}<p>only page</p>"), (11, None, f"{nav}<p>x</p>"), (12, "nothing", nav), (13, "http://a.example/z", None), (0, "http://a.example/0", "<p>again</p>"), (None, "http://a.example/n", nav)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, n_lines int")
    got = sorted(((str(r.page_id), r.host, r.n_lines, r.n_dropped, r.text) for r in l.drop_boilerplate(pages).collect()), key=str)
    assert ("3", "a.example", 3, 1, "Own line 3 & more\nOwn line 3 & more") in got
    assert ("10", "b.example", 2, 0, "Home page\nonly page") in got and ("11", None, 2, 0, "Home page\nx") in got and ("12", None, 1, 0, "Home page") in got
    assert ("13", "a.example", 0, 0, "") in got and ("None", "a.example", 1, 1, "") in got and len(got) == len(rows)
    assert l.drop_boilerplate(pages.limit(0)).count() == 0
