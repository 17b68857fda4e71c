"""Filters against counters, and copies against texts compared one by one."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup

SPACE = str.maketrans("", "", " \t\n\v\f\r")


@pytest.mark.parametrize("bits", [6, 20, 46, 62])
def test_filters_lose_nothing(bits):
    r = random.Random(bits)
    whole, filters = Counter(), []
    for size in (1, 2, 3, 40, 5000):
        some = Counter(r.choice([r.getrandbits(bits), r.getrandbits(3), (1 << bits) - 1]) for _ in range(size))
        some[r.getrandbits(bits)] += r.choice([1, 300, 1 << 40])
        prints = np.array(sorted(some), np.int64)
        filters.append(exact_dedup.build(prints, np.array([some[int(p)] for p in prints], np.int64), bits))
        got, counts = exact_dedup.entries(filters[-1])
        assert got.tolist() == sorted(some) and dict(zip(got.tolist(), counts.tolist())) == some
        whole += some
    got, counts = exact_dedup.merge(filters)
    assert got.tolist() == sorted(whole) and dict(zip(got.tolist(), counts.tolist())) == whole


def test_filter_is_smaller_than_its_fingerprints():
    r = np.random.default_rng(1)
    prints = np.unique(r.integers(0, 1 << 30, 100_000))
    assert len(exact_dedup.build(prints, np.ones(len(prints), np.int64), 30)) < 4 * len(prints)


def test_repeated_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HELD", 100)
    r = random.Random(3)
    values = [r.choice([r.getrandbits(40), r.getrandbits(9), 7]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "print bigint").repartition(7)
    got = {x.print: x.n for x in exact_dedup.repeated(df, 40, 4).collect()}
    assert got == {k: n for k, n in Counter(values).items() if n > 1}


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(SPACE), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        norm = (t or "").translate(SPACE)
        out.append((-1 if i is None else i, -1 if (k := min(groups[norm])[2]) is None else k, len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out)


def run(df):
    got = exact_dedup.exact_dedup(df).collect()
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in got)


def texts(r):
    base = ["same text", "sametext", "s ame\ttext\n", "", None, "   ", "é 🙂", "é🙂 ", "x" * 70_000, "x" * 70_000 + " ", "ab\x00c", "abc"]
    return [r.choice(base) if r.random() < 0.7 else f"only {r.random()}" for _ in range(300)]


@pytest.mark.parametrize("weak", [None, "print", "both"])
def test_against_brute_force(spark, documents, weak, monkeypatch):
    """Also with fingerprints, and digests, that are the same for texts that differ."""
    if weak:
        monkeypatch.setattr(exact_dedup, "_hash", lambda text: F.xxhash64(F.length(text) % 3))
    if weak == "both":
        monkeypatch.setattr(exact_dedup, "_told", lambda sha: F.when(F.hex(sha) < "8", F.lit(b"a")).otherwise(sha))
    r = random.Random(4)
    rows = [(r.choice([i, i, 7, None]), t) for i, t in enumerate(texts(r))]
    rows += rows[:5]
    df = documents([t for _, t in rows], ids=[i for i, _ in rows]).repartition(6)
    assert run(df) == brute(rows)


def test_a_third_of_all_rows_are_one_text(spark, documents):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i // 4}") for i in range(3000)]
    assert run(documents([t for _, t in rows], ids=[i for i, _ in rows]).repartition(8)) == brute(rows)
    assert exact_dedup.exact_dedup(documents(["x"]).limit(0)).collect() == []
