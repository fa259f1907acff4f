"""Functions in SQL text give what their columns give."""

from juriscope.functions import documents, quotes, sql
from juriscope.plans import queries

SF = "/root/testdata/sf0.001"


def test_table_function_of_blocks(spark):
    key = lambda r: (r.page_id, r.type, r.n, r.n_chars)
    got = sorted(map(key, queries.html_blocks_sql(spark, SF).collect()))
    assert got == sorted(map(key, queries.html_blocks(spark, SF).collect())) and got


def test_blocks_of_odd_texts(spark):
    sql.register(spark)
    texts = [(1, None), (2, ""), (3, "<p>One.</p><h2>Two</h2>"), (4, "bare")]
    frame = spark.createDataFrame(texts, "id long, html string")
    got = [tuple(r) for r in spark.sql("SELECT t.id, b.* FROM {t} t, LATERAL html_blocks(t.html) b ORDER BY id, pos", t=frame).collect()]
    assert got == [(i, pos, b["type"], b["html"]) for i, t in texts for pos, b in enumerate(documents.blocks_of(t or "")[0])]


def test_quotes(spark):
    sql.register(spark)
    text = "Rain fell on the mill. The miller closed the gate at noon, as Finch had asked."
    rows = [(text, "the miller CLOSED the gate"), (text, "nobody ever closed any other gate"), (None, "four words or more"), (text, None)]
    frame = spark.createDataFrame(rows, "text string, quote string")
    got = spark.sql("SELECT text, quote, verify_quote(array(coalesce(text, '')), quote) AS v, expand_quote(array(coalesce(text, '')), quote) AS e, mark_case(quote, array('1 U.S. 2'), 'Miller v. Finch') AS m FROM {t}", t=frame).collect()
    for r in got:
        stream = [quotes.Stream(quotes.tokens(r.text or ""))]
        assert tuple(r.v) == quotes.verify(stream, r.quote or "")
        assert r.e == (r.quote and quotes.expand([r.text or ""], r.quote)) and r.m == quotes.mark(r.quote or "", ["1 U.S. 2"], "Miller v. Finch")
