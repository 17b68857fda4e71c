"""Codes with pruning against plain rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4):
    """Plain Lloyd in Python's own integers."""
    good = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    length = len(min((g for g in good if g[0] is not None), key=lambda g: g[:2])[1])
    good = [g for g in good if len(g[1]) == length]
    width = length // 4
    first = {}
    for i, x, _ in sorted((g for g in good if g[0] is not None), key=lambda g: g[:2]):
        first.setdefault(i, x)
    start = list(first.values())[:entries]
    books = [[x[p * width : (p + 1) * width] for x in start] for p in range(4)]

    def nearest(p, x):
        part = x[p * width : (p + 1) * width]
        d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[p]]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        for p in range(4):
            held = {}
            for _, x, _ in good:
                held.setdefault(nearest(p, x)[0], []).append(x[p * width : (p + 1) * width])
            books[p] = [[sum(c) // len(c) for c in zip(*held[j])] if j in held else e for j, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(i, lab, [nearest(p, x) for p in range(4)]) for i, x, lab in good]
    total = {}
    for _, lab, n in out:
        total[lab] = total.get(lab, 0) + sum(d for _, d in n)
    return sorted((-99 if i is None else i, "".join(f"{j:02x}" for j, _ in n), sum(d for _, d in n), total[lab], digest) for i, lab, n in out)


def run(df):
    cols = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((*(-99 if r[c] is None else r[c] for c in cols),) for r in vector_codes.compress(df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_rounds(spark, seed):
    r = random.Random(seed)
    # few distinct values make ties and repeated vectors
    grid = [-0.75, -0.001, 0.0, 0.0004, 0.25, 1.0]
    rows = [(i, [r.choice(grid) if i % 3 else r.gauss(0, 0.2) for _ in range(8)], r.choice([None, 0, 1])) for i in range(700)]
    rows += [(800, None, 1), (801, [0.1, None] + [0.0] * 6, 1), (802, [math.nan] * 8, 0), (803, [math.inf] + [0.0] * 7, 0)]
    rows += [(804, [], 0), (805, [0.5] * 4, 2), rows[10], rows[10], (11, [-5.0] * 8, 3), (None, [0.3] * 8, 5), (-4, [0.2] * 8, None)]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    r.shuffle(rows)
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_few_rows_and_odd_tables(spark):
    rows = [(3, [0.5, -0.5, 0.1, 0.2], 1), (1, [0.5, 0.5, 0.1, 0.2], 1), (1, [0.4, 0.5, 0.1, 0.2], 2)]
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(df) == brute(rows)
    assert run(df.selectExpr("*", "'clash' code", "1 error", "2 x", "3 key", "4 n", "5 lower")) == run(df)
    assert vector_codes.compress(df.limit(0)).collect() == []
    assert vector_codes.compress(df.selectExpr("null vec_id", "embedding", "label")).collect() == []
    five = spark.createDataFrame([(1, [0.1, 0.2, 0.3, 0.4, 0.5], None), (2, [1e30, -1e30, 0.0, 0.0, 0.0], 1)], SCHEMA)
    got = run(five)  # the last part is filled up for both
    assert [x[1] for x in got] == ["00000000", "01010100"]


def test_pruned_rounds_equal_plain_ones_and_prune():
    r = np.random.default_rng(5)
    centres = r.integers(-500, 500, (40, 16))
    x = centres[r.integers(0, 40, 3000)] + r.integers(-20, 20, (3000, 16))
    book, state, needed = vector_codes.Codebook(x[:64].copy()), (None, None, None), []
    for _ in range(6):
        code, upper, lower, best = book.assign(x, *state)
        square = vector_codes.squared(x, book.entries)
        assert (code == square.argmin(1)).all()
        assert (upper.astype(float) ** 2 >= square[np.arange(len(x)), code]).all()
        assert (lower.astype(float) ** 2 <= square).all()
        needed.append((best >= 0).mean())
        entries = np.stack([x[code == j].sum(0) // max(1, (code == j).sum()) if (code == j).any() else e for j, e in enumerate(book.entries)])
        book, state = vector_codes.Codebook(entries, book.entries), (code, upper, lower)
    assert needed[-1] < 1


def test_distances_of_large_components_are_exact():
    x = np.array([[vector_codes.LARGEST, -vector_codes.LARGEST, 3, 1]] * 2, np.int64)
    c = np.array([[-vector_codes.LARGEST, vector_codes.LARGEST, 0, 0], [vector_codes.LARGEST - 1, -vector_codes.LARGEST, 3, 1]], np.int64)
    assert vector_codes.squared(x, c).tolist() == [[8 * vector_codes.LARGEST**2 + 10, 1]] * 2
    s = np.array([0, 1, 2, 3, 4, (1 << 51) - 1, 1 << 51, 8 * vector_codes.LARGEST**2])
    assert (vector_codes.root_down(s).astype(object) ** 2 <= s).all() and (vector_codes.root_up(s).astype(object) ** 2 >= s).all()
