"""Keyed tables and reports."""

import pytest

from tidemark.functions import prose as P
from tidemark.sources.store import KeyedTable, markdown_table, read_files


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "id", "id bigint, v string")
    assert t.read().collect() == []
    t.put(spark.createDataFrame([(1, "a"), (2, "b")], t.schema))
    old = t.read()
    t.put(spark.createDataFrame([(2, "c"), (3, "d")], t.schema))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, old.collect())) == [(1, "a"), (2, "b")]
    assert [r.v for r in t.get(3).collect()] == ["d"]
    t.delete(spark.createDataFrame([(1,)], "id bigint"))
    assert t.read().count() == 2
    t.clear()
    assert t.read().collect() == []


def test_reports(spark, tmp_path):
    assert markdown_table(spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string")) == "| n | t |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n"
    with pytest.raises(ValueError):
        markdown_table(spark.range(5), most=3)
    (tmp_path / "a.html").write_text("<p>x</p>")
    (tmp_path / "b.html").write_text("")
    expected = spark.createDataFrame([("a.html",), ("b.html",), ("c.html",)], "name string")
    got = {r.name: r.status for r in read_files(expected, str(tmp_path)).collect()}
    assert got == {"a.html": "changed", "b.html": "failed", "c.html": "failed"}


def test_prose():
    text = "One two three. " * 50
    cut = P.excerpt(text, 20)
    assert cut.endswith(" …") and text.startswith(cut[:-2]) and P.excerpt("short") == "short"
    assert "".join(p for _, p in P.split_text("word " * 3000)) == "word " * 3000
    assert all(len(p) <= 5120 for _, p in P.split_text("word " * 3000)) and [a for a, _ in P.split_text("x" * 6000)] == [0, 5120]
    doc = {"a": [{"b": 1}, {"b": 2}], "c": {"x": 3}}
    assert P.json_path(doc, "a.*.b") == [1, 2] and P.json_path(doc, "c.*") == [3] and P.json_path(doc, "a.1.b") == [2] and P.json_path(doc, "q.z") == []
    assert P.arguments_match({"a": 1, "b": ["x"]}, {"a": 1.0, "b": [" x", "y"], "c": 0}) and not P.arguments_match({"a": True}, {"a": 1})
    assert not P.arguments_match(["x", "y"], ["x"]) and P.arguments_match({"memberId": "me"}, {"memberId": "[M]"}, {"me": "[M]"})
    assert P.leaks('{"n": ["call 555 0100 99"], "k": "Jane Doe"}', {"5550-10099": "phone", "jane doe": "name", "doe j": "x"}) == [("phone", "$.n[0]"), ("name", "$.k")]
