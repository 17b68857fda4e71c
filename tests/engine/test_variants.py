"""Paths into JSON on VARIANT against the rule in Python."""

import json
import random

from pyspark.sql import functions as F

from tidemark.functions import prose
from tidemark.functions.variants import as_texts, json_values

PATHS = ["a", "*", "a.*", "*.*", "a.0", "1.b", "b.*.a", "*.*.*", "0", "c d.2", "x", "99999999999999999999"]


def value(r, depth):
    kind = r.choice("olsnbz" if depth else "snbz")
    if kind == "o":
        return {k: value(r, depth - 1) for k in sorted(r.sample(["0", "1", "a", "b", "c d"], r.randint(0, 4)))}
    if kind == "l":
        return [value(r, depth - 1) for _ in range(r.randint(0, 4))]
    return {"s": r.choice(["", "é", "x.y"]), "n": r.choice([0, -7, 2.5, 10**15]), "b": r.random() < 0.5, "z": None}[kind]


def test_paths(spark):
    r = random.Random(2)
    docs = [(i, json.dumps(value(r, 4), ensure_ascii=r.random() < 0.5)) for i in range(300)] + [(300, None), (301, "no json"), (302, "null"), (303, "")]
    df = spark.createDataFrame(docs, "id int, j string").repartition(3)
    shown = lambda v: F.transform(v, lambda x: F.to_json(x))
    got = df.select("id", *[shown(json_values(F.col("j"), p)).alias(f"p{i}") for i, p in enumerate(PATHS)])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows, hits = {x.id: x for x in got.collect()}, 0
    for i, text in docs:
        document = json.loads(text) if text and text != "no json" else ...
        for k, p in enumerate(PATHS):
            want = [] if document is ... else prose.json_path(document, p)
            assert [json.loads(x) for x in rows[i][f"p{k}"]] == want, (text, p)
            hits += len(want)
    assert hits > 500
    one = spark.createDataFrame([('{"a": ["x", 1, {"b": null}, true]}',)], "j string").select(as_texts(json_values(F.col("j"), "a.*")).alias("t")).first()
    assert one.t == ["x", "1", '{"b":null}', "true"]
