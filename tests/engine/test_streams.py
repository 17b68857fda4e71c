"""Guards: sliding limits, caps, folds; batch and streaming give the same."""

import datetime
import hashlib
import json
import random

import pytest

from tidemark.functions.text import token_set_ratio
from tidemark.operators import conversation, evals
from tidemark.operators.conversation import MessageFold
from tidemark.streaming import guards

T0 = datetime.datetime(2024, 1, 1)


def test_waits():
    assert guards.waits([0, 1, 2, 3, 60.5, 61.5], [], 2, 60) == [None, None, 58, 57, None, None]
    r = random.Random(3)
    for _ in range(50):
        times, most = sorted(r.uniform(0, 50) for _ in range(60)), r.randint(1, 6)
        got, admitted = guards.waits(times, [], most, 7.0), []
        for t, wait in zip(times, got):
            inside = [x for x in admitted if x > t - 7.0]
            assert (wait is None) == (len(inside) < most)
            if wait is None:
                admitted.append(t)
            else:
                assert wait - 1 < inside[0] + 7.0 - t <= wait


@pytest.fixture(scope="module")
def hits():
    r = random.Random(1)
    times = sorted(r.uniform(0, 600) for _ in range(300))
    return [(i, r.randrange(3), T0 + datetime.timedelta(seconds=t)) for i, t in enumerate(times)]


def run_stream(df, tmp_path, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_rate_limit_stream_is_batch(spark, tmp_path, hits):
    schema = "event_id bigint, user_id bigint, ts timestamp"
    df = spark.createDataFrame(hits, schema)
    batch = {r.event_id: (r.allowed, r.retry_after) for r in guards.rate_limit(df, "user_id", "ts", "event_id", 5, 60).collect()}
    for k in range(3):
        spark.createDataFrame(hits[k * 100 : (k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_stream(guards.rate_limit_stream(source, "user_id", "ts", "event_id", 5, 60), tmp_path, "append", "limited")
    assert {r.event_id: (r.allowed, r.retry_after) for r in got} == batch
    assert any(not a for a, _ in batch.values())


def test_bins_and_spend(spark, tmp_path, hits):
    schema = "event_id bigint, user_id bigint, ts timestamp"
    spark.createDataFrame(hits, schema).write.parquet(str(tmp_path / "in"))
    from pyspark.sql import functions as F

    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    spent = run_stream(guards.daily_spend_stream(source, "user_id", F.lit(1)), tmp_path / "a", "update", "spent")
    assert sum(r.spent for r in spent) == 300
    out = run_stream(guards.bins_stream(source, "1 minute", "0 seconds", ["user_id"], F.lit(1)), tmp_path / "b", "append", "binned")
    assert 0 < sum(r.n for r in out) < 300  # the last minute isn't over


EVENTS = [
    {"type": "start", "messageId": "m"}, {"type": "start-step"}, {"type": "text-start", "id": "t"}, {"type": "text-delta", "id": "t", "delta": "he"},
    {"type": "text-delta", "id": "t", "delta": "y"}, {"type": "text-end", "id": "t"}, {"type": "data-x", "id": "d", "data": 1},
    {"type": "data-x", "id": "d", "data": 2}, {"type": "data-y", "data": 3, "transient": True}, {"type": "start-step"},
    {"type": "tool-input-start", "toolCallId": "c", "toolName": "get"}, {"type": "tool-input-available", "toolCallId": "c", "toolName": "get", "input": {"a": 1}},
    {"type": "tool-output-available", "toolCallId": "c", "output": 5}, {"type": "finish", "finishReason": "stop"},
]


def test_message_fold(spark, tmp_path):
    f = MessageFold.of(EVENTS)
    kinds = [(p["type"], p.get("state"), p.get("text") or p.get("data") or p.get("output")) for p in f.message["parts"]]
    assert kinds == [("step-start", None, None), ("text", "done", "hey"), ("data-x", None, 2), ("step-start", None, None), ("tool-get", "output-available", 5)]
    assert f.continues() and not MessageFold.of(EVENTS[:-2]).continues() and f.message["finish"] == "stop"
    rows = [(1, i, json.dumps(e)) for i, e in enumerate(EVENTS)] + [(2, i, json.dumps(e)) for i, e in enumerate(EVENTS[:5])]
    schema = "message_id bigint, seq bigint, event string"
    batch = {r.message_id: r.json for r in conversation.fold_messages(spark.createDataFrame(rows, schema)).collect()}
    for k in range(2):
        half = [x for x in rows if (x[1] < 4) == (k == 0)]
        spark.createDataFrame(half, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_stream(guards.fold_stream(source), tmp_path, "update", "folded")
    assert batch[1] in {r.json for r in got} and batch[2] in {r.json for r in got}


def test_fold_of_odd_events():
    m = MessageFold.of([
        {"type": "text-start", "id": "0"}, {"type": "text-delta", "id": "0", "delta": "one"}, {"type": "text-end", "id": "0"},
        {"type": "text-start", "id": "0"}, {"type": "text-delta", "id": "0", "delta": "two"}, {"type": "text-end", "id": "9"},
        {"type": "text-delta", "id": "1", "delta": "x"}, {"type": "tool-approval-request", "toolCallId": "u", "approvalId": "a"},
        {"type": "tool-output-available", "toolCallId": "u", "output": 1}, {"type": "tool-output-denied", "toolCallId": "u"},
        {"type": "tool-output-error", "toolCallId": "v"}, {"type": "tool-input-error", "toolCallId": "w", "toolName": "t", "input": 2},
        {"type": "tool-approval-request", "toolCallId": "w", "approvalId": "b"}, {"type": "unknown"}, {}, {"type": "message-metadata", "messageMetadata": {"agent": "k"}},
        {"type": "error"}, {"type": "abort"},
    ]).message
    assert [(p["type"], p.get("text"), p["state"]) for p in m["parts"]] == [
        ("text", "one", "done"), ("text", "two", "streaming"), ("text", "x", "streaming"), ("tool-t", None, "approval-requested")
    ]
    assert m["parts"][-1]["approval"] == {"id": "b"} and m["parts"][-1]["input"] == 2 and m["parts"][-1]["errorText"] == ""
    assert m["approvals"] == {"u": "a", "w": "b"} and m["outputs"] == {"u": 1} and m["errors"] == {"v": None} and m["denied"] == ["u"]
    assert (m["metadata"], m["error"], m["finish"]) == ({"agent": "k"}, "error", "abort")


def test_page_caps(spark):
    d = datetime.date(2024, 1, 1)
    many = list(range(1, 121))
    rows = [("ip", d, 0, "a", [1, 2]), ("ip", d, 1, "a", [130]), ("ip", d, 2, "b", [1]), ("ip", d, 3, "c", [1]), ("ip", d, 4, "d", [1]), ("ip", d, 5, "a", many), ("other", d, 6, "a", many),
            ("other", d, 7, "d", many), ("other", d, 8, "d", [121]), ("ip", d, 9, "d", [5] * 118), ("ip", d, 10, "d", [5] * 3)]
    got = guards.page_caps(spark.createDataFrame(rows, "ip string, day date, seq bigint, document string, pages array<int>")).collect()
    assert [r.verdict for r in sorted(got, key=lambda r: r.seq)] == ["ok", "page_cap", "ok", "ok", "booklet_cap", "ok", "page_cap", "ok", "page_cap", "booklet_cap", "page_cap"]


def test_replay(spark):
    rows = [(1, 0, "user", "bad"), (1, 1, "assistant", "no"), (1, 2, "user", "hi"), (1, 3, "assistant", "hello"), (1, 4, "system", "x"), (1, 5, "assistant", " ")]
    t = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = conversation.replay(t, t.text == "no").orderBy("turn").collect()
    assert [(r.turn, r.in_current_turn, r.item) for r in got] == [(2, False, 1), (3, True, 2)]


def test_gates(spark):
    m = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("c", 2.0)], "metric string, value double")
    t = spark.createDataFrame([("a", 0.9, None, True), ("b", 0.5, None, True), ("c", None, 1.0, True), ("d", 0.1, None, True), ("e", 0.1, None, False)], "metric string, low double, high double, required boolean")
    assert {r.metric: r.status for r in evals.gate_summary(m, t).collect()} == {"a": "pass", "b": "fail", "c": "fail", "d": "fail", "e": "skipped"}


def test_greedy_match(spark):
    a = spark.createDataFrame([("g", 1, "massage therapy"), ("g", 2, "massage"), ("h", 1, "x y")], "g string, id bigint, name string")
    b = spark.createDataFrame([("g", 7, "therapy massage"), ("i", 1, "z")], "g string, id bigint, name string")
    rows = sorted((r.g, r.golden_id, r.predicted_id) for r in evals.greedy_match(a, b, "g").collect() if r.golden_id)
    assert rows[0] == ("g", 1, 7) and rows[1][:2] == ("g", 2)
    acc = {r.g: (r.correct, r.total) for r in evals.accuracy(evals.greedy_match(a, b, "g"), "g").collect()}
    assert acc == {"g": (1, 2), "h": (0, 1), "i": (0, 1)}


def slow_match(golden, predicted, threshold):
    """(golden id, predicted id, score), every name scored with every other of its kind."""
    free, out = dict(sorted((i, (n, k)) for i, n, k in predicted)), []
    for i, name, kind in sorted(golden):
        best = max(((token_set_ratio(name, n), -j) for j, (n, k) in free.items() if k == kind), default=(-1.0, 0))
        if best[0] >= threshold:
            out.append((i, -best[1], best[0]))
            del free[-best[1]]
        else:
            out.append((i, None, None))
    return out + [(None, i, None) for i in free]


def test_greedy_match_of_many(spark):
    r = random.Random(5)
    name = lambda: " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 3)))
    rows = [[(i, name(), r.choice(["k", "l", None])) for i in r.sample(range(500), 150)] for _ in range(2)]
    a, b = (spark.createDataFrame([("g", *x) for x in side], "g string, id bigint, name string, kind string") for side in rows)
    for threshold in (50.0, 80.0, 100.0):
        got = [(x.golden_id, x.predicted_id, x.score) for x in evals.greedy_match(a, b, "g", threshold, "kind").collect()]
        order = lambda x: (x[0] is None, x[0] or 0, x[1] or 0)
        assert sorted(got, key=order) == sorted(slow_match(*rows, threshold), key=order)


def test_greedy_match_scores_few():
    """Names without a partner are not scored with every other: 400 of 32 letters and figures against 400."""
    names = [hashlib.md5(str(i).encode()).hexdigest() for i in range(800)]
    known = evals._Names(names[:400])
    assert sum(len(known.near(n, 80.0)) + len(known.sharing(n)) for n in names[400:]) < 0.05 * 400 * 400
