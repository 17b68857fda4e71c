"""The trie of conversations against one built turn by turn."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LONGS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def brute(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    nodes = {}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        seq = turns.get(c - c % 100, [])[:h] + turns[c][h:]
        for d in range(len(seq) + 1):
            n = nodes.setdefault(tuple(seq[:d]), {"convs": [], "ends": []})
            n["convs"].append(c)
            if d == len(seq):
                n["ends"].append(c)
    for key, n in nodes.items():
        n["children"] = [k for k in nodes if len(k) == len(key) + 1 and k[: len(key)] == key]
    done = {}
    for key in sorted(nodes, key=len, reverse=True):
        n = nodes[key]
        own = (len(n["convs"]) - 1) * (len(key[-1][1]) if key else 0)
        below = [done[k] for k in n["children"]]
        done[key] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
    return sorted(
        (
            min(n["convs"]), len(key), -1 if not key else min(nodes[key[:-1]]["convs"]), len(n["convs"]), len(n["children"]),
            *done[key], hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest(),
        )
        for key, n in nodes.items()
    )


def run(df):
    got = prefix_trie.prefix_trie(df).collect()
    return sorted((*(-1 if r[c] is None else r[c] for c in LONGS), r.ends_sha256) for r in got)


def some(seed, convs=60):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(260), convs):
        for t in range(r.choice([0, 1, 2, 3, 7, 12])):
            rows.append((c, t if t or r.random() < 0.8 else None, r.choice(["user", "assistant", None]), r.choice(["a", "bé", "", None, "🙂 x"])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    rows = some(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert run(df) == brute(rows)


def test_one_conversation_of_very_many_turns(spark):
    """Deeper than a stretch, and a third of all rows; a twin shares all but its last turn."""
    rows = [(7, t, "user", f"t{t % 9}") for t in range(9001)] + [(107, t, "user", f"t{t % 9}" if t < 9000 else "end") for t in range(9001)]
    rows += [(c, 0, "user", "hi") for c in range(200, 230)]
    got = run(spark.createDataFrame(rows, SCHEMA).repartition(6))
    depth = {}
    for c, d, *_ in got:
        depth[c] = max(depth.get(c, 0), d)
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in (7, 107)}
    assert depth[7] == 9001 - h[7] and depth[107] == 9001 - h[107]
    (root,) = [x for x in got if x[1] == 0]
    assert root[3] == 32 and root[5] == sum(x[4] == 0 for x in got)
    shared = [x for x in got if x[3] > 1 and x[1] > 0]
    assert root[6] == sum((x[3] - 1) * 2 for x in shared)


def test_members_without_turns_and_odd_rows(spark):
    # 105 has fewer turns than it takes from an absent 100, and so none at all
    none = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(none, 0, "user", "x"), (None, 0, "user", "lost"), (3, None, None, None), (3, 1, "", ""), (3, 1, "", ""), (-5, 0, "user", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = run(df.selectExpr("*", "'clash' node", "1 depth", "2 n_convs", "'p' parent", "true ends", "3 w0"))
    assert got == run(df) and got[0][:2] == (-5, 0)
    (root,) = [x for x in got if x[1] == 0]
    assert root[3] == 3
    assert got == brute(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == []


def test_digests_over_batches():
    import pyarrow as pa

    rows = [(b"a", 1), (b"a", 2), (b"b", 10), (b"b", 11), (b"b", 12), (b"c", 5)]
    for size in (1, 2, 4, 9):
        batches = [pa.RecordBatch.from_pylist([{"node": n, "conv": c} for n, c in rows[i : i + size]]) for i in range(0, len(rows), size)]
        got = {r["node"]: r["ends_sha256"] for b in prefix_trie._hash_lists(iter(batches)) for r in b.to_pylist()}
        want = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in ((b"a", "1,2"), (b"b", "10,11,12"), (b"c", "5"))}
        assert got == want
    assert list(prefix_trie._hash_lists(iter([]))) == []
