"""Functions by name give in SQL what they give in Python."""

from tidemark.functions import labels, sql, text
from tidemark.operators import ingest


def test_functions_in_sql(spark):
    names = sql.register(spark)
    assert {"chunk_markdown", "names_match", "labelled_values"} <= set(names)
    words = "alpha beta gamma. " * 80
    docs = [(1, f"# One\n\n{words}\n\n## Two\n\n{words}"), (2, ""), (3, None), (4, "Policy no: AB-1234-99\nsin 046 454 286")]
    spark.createDataFrame(docs, "doc_id bigint, text string").createOrReplaceTempView("sql_docs")
    got = spark.sql("SELECT doc_id, c.* FROM sql_docs, LATERAL chunk_markdown(text, 100, 20, 30) AS c ORDER BY doc_id, chunk").collect()
    want = [(i, k, c.section, c.content, c.tokens) for i, t in docs if t for k, c in enumerate(ingest.chunk_markdown(t, 100, 20, 30))]
    assert [tuple(r) for r in got] == want and len(want) > 5
    row = {r.doc_id: r for r in spark.sql("SELECT doc_id, count_tokens(text) n, labelled_values(text) v, identifiers(text) s, quote_score('alpha~ beta', text) q FROM sql_docs").collect()}
    short = {r.doc_id: r for r in spark.sql("SELECT doc_id, e.* FROM sql_docs, LATERAL excerpt(text, 12) AS e").collect()}
    assert row[1].n == text.count_tokens(docs[0][1]) and row[1].q == 100 and row[3].n is None
    assert set(short) == {1, 2, 4} and short[1].excerpt.endswith("…") and short[2].whole
    assert [(v.label, v.where) for v in row[4].v] == [(v.label, v.where) for v in labels.values(docs[3][1])] and row[4].s[0].value == "046 454 286"
    one = spark.sql("SELECT names_match('Massage Therapy', 'therapy massage') a, partial_ratio('abc', 'xabcx') b, normalize_text('A~b') c, html_to_markdown('<p>x</p>') d, names_match(null, 'x') e").first()
    assert (one.a, one.b, one.c, one.d.strip(), one.e) == (100.0, 100.0, "a b", "x", None)
