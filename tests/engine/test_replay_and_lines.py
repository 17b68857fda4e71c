"""What a model sees again of calls, and lines of files that can't be read."""

import json

import pytest

from tidemark.operators import conversation as C
from tidemark.sources import readers


def call(name, output, **more):
    return {"type": f"tool-{name}", "toolCallId": "c", "state": "output-available", "input": {}, "output": output} | more


def contents(*parts):
    return [i["content"] for i in C.message_items("assistant", json.dumps(parts)) if i["type"] == "function_call_output"]


def test_outputs_of_server_tools():
    found = {"results": [{"sourceId": "s&1", "title": 'A "b"', "url": None, "snippet": "x < y & 'z'"}, "no row", {"snippet": None}], "query": "q"}
    want = (
        '<documents>\n<document source="s&amp;1" title="A &quot;b&quot;" publisher="" license="" url="">\nx &lt; y &amp; \'z\'\n</document>\n'
        '<document source="" title="" publisher="" license="" url="">\n\n</document>\n</documents>'
    )
    assert contents(call("search_public_knowledge", found, providerExecuted=True)) == [want]
    assert contents(call("search_public_knowledge", {"results": []}, providerExecuted=True)) == ["<documents></documents>"]
    # run by the browser, or of another form: as it is
    assert contents(call("search_public_knowledge", {"results": []})) == ['{"results":[]}']
    assert contents(call("search_public_knowledge", {"results": "none"}, providerExecuted=True)) == ['{"results":"none"}']
    assert contents(call("ask_knowledge_agent", {"answer": "yes", "steps": 3}, providerExecuted=True)) == ['{"answer":"yes","sources":[]}']
    assert contents(call("other", 5, providerExecuted=True)) == ['{"result":5}']


def test_signatures_of_declined_calls():
    gone = lambda given: {"type": "tool-pay", "toolCallId": "c", "state": "output-denied", "input": given}
    told = [C.message_items("assistant", json.dumps([gone(g)]))[0]["declined"] for g in ({"b": 1, "a": 2}, '{"a": 2, "b": 1}', "no json", None)]
    assert told == ['pay:{"a":2,"b":1}', 'pay:{"a":2,"b":1}', 'pay:"no json"', "pay:{}"]


def test_lines_that_cannot_be_read(spark, tmp_path):
    """Numbers are right over splits of a file and over files."""
    bad = {"a.jsonl": [3, 70, 200], "b.jsonl": [1], "c.jsonl": []}
    for name, lines in bad.items():
        rows = ["" if i == 10 else '{"x": ' if i in lines else json.dumps({"x": i, "y": "é" * (i % 40)}) for i in range(1, 201)]
        (tmp_path / name).write_text("\n".join(rows) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        errors = readers.jsonl_errors(spark, str(tmp_path), "x int, y string")
        assert sorted((r.file.rsplit("/", 1)[-1], r.line) for r in errors.collect()) == [(f, n) for f, lines in sorted(bad.items()) for n in lines]
        with pytest.raises(ValueError, match=r"^a\.jsonl:3: .*\{\"x\": "):
            readers.read_jsonl(spark, str(tmp_path), "x int, y string", fail_fast=True)
        good = readers.read_jsonl(spark, str(tmp_path / "c.jsonl"), "x int, y string", fail_fast=True)
        assert len(good.collect()) == 199
        assert sum(r._corrupt is not None for r in readers.read_jsonl(spark, str(tmp_path), "x int, y string").collect()) == 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
