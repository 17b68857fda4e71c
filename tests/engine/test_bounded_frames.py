"""What a task holds at once: scores of vectors, hits in texts."""

import numpy as np
import pandas as pd

from tidemark.operators import known_values, search


def test_hits_leave_in_frames():
    """A batch of many hits is not one frame."""
    sizes = [len(f) for f in known_values.in_frames(([(i, j) for j in range(700)] for i in range(100)), ["a", "b"])]
    assert sum(sizes) == 70_000 and max(sizes) < known_values.AT_ONCE + 700


def test_scores_are_held_a_few_at_a_time(monkeypatch):
    """The best of all, ties by id, with no product of all queries and vectors of a frame."""
    r = np.random.default_rng(3)
    vectors = np.repeat(r.integers(-3, 4, (150, 4)), 6, axis=0).astype(np.float64) + 0.5
    ids = r.permutation(len(vectors)).astype(np.int64)
    frames = [pd.DataFrame({"vec_id": ids[a : a + 450], "embedding": list(vectors[a : a + 450])}) for a in (0, 450)]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    largest, partition = [], np.partition
    monkeypatch.setattr(search, "SCORES", 1)
    monkeypatch.setattr(np, "partition", lambda a, *x, **y: largest.append(a.size) or partition(a, *x, **y))
    out = pd.concat(search._nearest(ids[:40], unit[:40], iter(frames), 5))
    assert max(largest) <= 40 * 64 and len(out) == 40 * 5
    for at in range(40):
        score = np.round(unit[at] @ unit.T, 9)
        want = sorted((-s, i) for s, i in zip(score, ids) if i != ids[at])[:5]
        mine = out[out.query_id == ids[at]]
        assert np.allclose(sorted(-mine.score), [s for s, _ in want])


def test_lines_are_sorted_in_one_place(spark, monkeypatch):
    """Lines of claims are shuffled once and sorted twice to be numbered, joined and given parts, in tasks of so many lines at most
    whatever the session's partitions."""
    from tidemark.plans import benefits
    from tidemark.sources import adapter

    sf = "/root/testdata/sf0.001"
    whole = benefits.allocate_outcomes(spark, sf)
    monkeypatch.setattr(adapter, "LINES_A_TASK", 500)
    small = benefits.allocate_outcomes(spark, sf)
    assert small.rdd.getNumPartitions() == 6000 // 500 + 1 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for threshold, sorts in (("-1", 3), ("10m", 2)):  # one of them of the claims, where they are not broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            plan = benefits.allocate_outcomes(spark, sf)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert (plan.count("Exchange hashpartitioning"), plan.count("- Sort [")) == (sorts - 1, sorts)
    assert sorted(small.collect()) == sorted(whole.collect())


def test_parts_without_weight_or_total(spark):
    """Without any weight the first row has all; ties of remainders and of weights go by order; no total, no parts."""
    from tidemark.functions.money import allocate

    rows = [(1, 2, 7, 0), (1, 1, 7, None), (1, 3, 7, -4), (2, 1, 10, 1), (2, 2, 10, 1), (2, 3, 10, 1), (3, 1, None, 5), (3, 2, None, 0), (4, 1, 0, 0), (5, 1, 5, 0), (5, 1, 5, 0), (6, 1, None, 0)]
    out = allocate(spark.createDataFrame(rows, "g int, o int, total bigint, w bigint"), ["g"], ["o"], "total", "w")
    assert out.columns == ["g", "o", "total", "w", "part"]
    got = sorted((r.g, r.o, r.part is None, r.part or 0) for r in out.collect())
    none = [(3, 1, True, 0), (3, 2, True, 0), (4, 1, False, 0), (5, 1, False, 0), (5, 1, False, 5), (6, 1, True, 0)]
    assert got == [(1, 1, False, 7), (1, 2, False, 0), (1, 3, False, 0), (2, 1, False, 4), (2, 2, False, 3), (2, 3, False, 3), *none]
