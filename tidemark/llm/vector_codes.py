"""Codes of vectors by parts, trained with Elkan's form of Lloyd's rounds on integers.

Each of four parts of a vector has a codebook of 256 entries. Between rounds every row keeps, for each part, its entry, an
upper bound of its distance to that one and a lower bound of its distance to every entry. Bounds are whole numbers (upper
ones rounded up, lower ones down), are shifted by how far entries have moved, and rule out entries that are strictly
further by the triangle inequality. Whatever is left is decided by exact integer distances, ties to the lower index, so that
results are those of the plain rounds.

Rows stay in their partitions: a round reads them with their bounds, writes both again, and sends sums of at most 1,024
entries a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, split_join

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components beyond this in size are set to it, so that distances fit in 64 bits.
LARGEST = 1 << 27
NO_BOUND = np.iinfo(np.uint16).max


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, x): the rows whose vector has components, none of them null, infinite or NaN."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # within what a long holds before it is rounded down
    scaled = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-(2.0**50)), F.least(F.lit(2.0**50), c)) * SCALE).cast("bigint"))
    x = F.transform(scaled, lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c)).cast("int"))
    fit = v.isNotNull() & (F.size(v) > 0) & ~bad
    return vectors.where(fit).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), x.alias("x"))


def smallest(rows: DataFrame, most: int) -> list[list[int]]:
    """The vectors of the ``most`` smallest ids, each id's smallest: a top list of each task, again beyond its last id as long
    as repeated ids leave it short."""
    out: dict = {}
    left = rows.where("vec_id is not null")
    while len(out) < most:
        got = left.select("vec_id", "x").orderBy("vec_id", "x").limit(4 * most).collect()
        for r in got:
            out.setdefault(r.vec_id, r.x)
        if len(got) < 4 * most:
            break
        left = left.where(F.col("vec_id") > F.lit(got[-1].vec_id))
    return list(out.values())[:most]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to rows of ``c``, as int64."""
    far = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if int(far) ** 2 * 4 * x.shape[1] < 1 << 52:  # all sums are whole numbers that doubles hold
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, entry in enumerate(c.astype(np.int64)):
        d = x - entry
        out[:, j] = (d * d).sum(1)
    return out


def root_down(square: np.ndarray) -> np.ndarray:
    """Whole numbers not above the roots, nor below them by more than two."""
    r = np.floor(np.sqrt(square.astype(np.float64)))
    return np.maximum(np.where(square < 1 << 52, r, r - 1), 0).astype(np.int64)


def root_up(square: np.ndarray) -> np.ndarray:
    r = np.ceil(np.sqrt(square.astype(np.float64)))
    return np.where(square < 1 << 52, r, r + 1).astype(np.int64)


class Codebook:
    """One part's entries, with what a round needs to know of them."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        between = squared(entries, entries)
        self.half = root_down(between) / 2  # a lower bound of half the distance
        apart = self.half + np.where(np.eye(len(entries), dtype=bool), np.inf, 0)
        self.nearest = apart.min(1)
        self.moved = np.zeros(len(entries), np.int64) if before is None else root_up(((entries - before) ** 2).sum(1))

    def assign(self, x: np.ndarray, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
        """(code, upper, lower, squared distance or -1 where it was not needed) of each row of ``x``."""
        if code is None:
            square = squared(x, self.entries)
            code = square.argmin(1)  # the first of equal ones
            best = square[np.arange(len(x)), code]
            return code, root_up(best), np.minimum(root_down(square), NO_BOUND).astype(np.uint16), best
        upper = upper + self.moved[code]
        # a bound at the top of its type stays a bound as it shrinks
        lower = np.maximum(lower.astype(np.int64) - self.moved[None, :], 0)
        best = np.full(len(x), -1, np.int64)
        rows = np.flatnonzero(upper >= self.nearest[code])
        if len(rows):
            near, own = x[rows], code[rows]
            d = near - self.entries[own]
            exact = (d * d).sum(1)
            tight = root_up(exact)
            best[rows] = exact
            # strictly further entries are out; as tight is rounded up, what it rules out is further than the distance itself
            left = (lower[rows] <= tight[:, None]) & (self.half[own] <= tight[:, None])
            left[np.arange(len(rows)), own] = False
            i, j = np.nonzero(left)
            square = np.full(left.shape, np.iinfo(np.int64).max)
            square[np.arange(len(rows)), own] = exact
            for a in range(0, len(i), 1 << 20):
                p, q = i[a : a + (1 << 20)], j[a : a + (1 << 20)]
                d = near[p] - self.entries[q]
                square[p, q] = (d * d).sum(1)
            lower[rows[i], j] = root_down(square[i, j])
            lower[rows, own] = root_down(exact)
            code, upper = code.copy(), upper.copy()
            code[rows] = square.argmin(1)
            best[rows] = square[np.arange(len(rows)), code[rows]]
            upper[rows] = root_up(best[rows])
        return code, upper, np.minimum(lower, NO_BOUND).astype(np.uint16), best


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A binary column of equal lengths as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _round(books: list[Codebook], width: int, last: bool) -> Callable:
    """A task's part of a round: rows with codes and bounds of the round before (or none yet) to rows with those of this."""
    sizes = len(books[0].entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = _matrix(b.column("x"), np.int32, PARTS * width).astype(np.int64)
            known = "lower" in b.schema.names
            if known:
                codes, uppers = _matrix(b.column("codes"), np.uint8, PARTS), _matrix(b.column("upper"), np.int64, PARTS)
                lowers = _matrix(b.column("lower"), np.uint16, PARTS * sizes).reshape(n, PARTS, sizes)
            out = []
            for p, book in enumerate(books):
                part = x[:, p * width : (p + 1) * width]
                args = (codes[:, p].astype(np.int64), uppers[:, p], lowers[:, p]) if known else (None, None, None)
                code, upper, lower, best = book.assign(part, *args)
                if last:  # of rows that no bound let in, the distance is still wanted
                    d = part - book.entries[code]
                    best = (d * d).sum(1)
                out.append((code, upper, lower, best))
            codes = np.stack([o[0] for o in out], 1).astype(np.uint8)
            columns = {"vec_id": b.column("vec_id"), "label": b.column("label")}
            if last:
                columns["code"] = pa.array([r.tobytes().hex() for r in codes], pa.string())
                columns["error"] = pa.array(np.stack([o[3] for o in out], 1).sum(1), pa.int64())
            else:
                columns |= {"x": b.column("x"), "codes": _binary(codes), "upper": _binary(np.stack([o[1] for o in out], 1))}
                columns["lower"] = _binary(np.stack([o[2] for o in out], 1).reshape(n, -1))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _sums(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(PARTS * ENTRIES, np.int64), np.zeros((PARTS * ENTRIES, width), np.int64)
        for b in batches:
            x = _matrix(b.column("x"), np.int32, PARTS * width).astype(np.int64).reshape(-1, width)
            at = (_matrix(b.column("codes"), np.uint8, PARTS) + np.arange(PARTS) * ENTRIES).reshape(-1)
            n += np.bincount(at, minlength=PARTS * ENTRIES)
            np.add.at(total, at, x)
        used = np.flatnonzero(n)
        arrays = [pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), pa.array(total[used].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["entry", "n", "total"])

    return run


def _means(rows: DataFrame, width: int) -> list:
    """(entry, n, sums) of the entries in use, at most PARTS * ENTRIES rows."""
    got = rows.select("x", "codes").mapInArrow(_sums(width), "entry int, n bigint, total array<bigint>")
    sums = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
    return got.groupBy("entry").agg(F.sum("n").alias("n"), *sums).collect()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): one row for each vector that can be coded.

    Components x become floor(1024 x). A vector that is null or empty, or holds a null, infinite or NaN component, is left
    out, as is one whose length differs from that of the smallest vec_id's; lengths that four does not divide are filled up
    with zeros, which add to no distance. Components beyond 2^17 in size count as that, so that distances fit in a long.
    Codebooks start from the 256 smallest ids, or as many as there are; of rows with one id the smallest vector starts, and
    rows without an id start nothing, unless no row has one: then nothing can start and no row is returned. All rows are
    coded, repeated ones too. label_error is the sum over rows of the same label, nulls being one. An empty table gives no
    rows. Columns of other names play no part.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as kept:
        rows = kept.keep(integers(vectors, id_col, vector_col, label_col))
        ids = {f.name: f.dataType.simpleString() for f in rows.schema}
        result = f"vec_id {ids['vec_id']}, code string, error bigint, label_error bigint, codebooks_sha256 string"
        first = smallest(rows, 1)
        if not first:
            return spark.createDataFrame([], result)
        length = len(first[0])
        width = -(-length // PARTS)
        fit = rows.where(F.size("x") == length)
        starts = smallest(fit, ENTRIES)
        start = np.zeros((len(starts), PARTS * width), np.int64)
        start[:, :length] = starts
        books = [Codebook(start[:, p * width : (p + 1) * width]) for p in range(PARTS)]

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                flat = np.zeros((b.num_rows, PARTS * width), np.int32)
                flat[:, :length] = b.column("x").flatten().to_numpy().reshape(b.num_rows, length)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _binary(flat)], names=["vec_id", "label", "x"])

        named = f"vec_id {ids['vec_id']}, label {ids['label']}"
        state = kept.keep(fit.mapInArrow(packed, f"{named}, x binary"))
        for _ in range(rounds):
            before = state
            state = kept.keep(state.mapInArrow(_round(books, width, False), f"{named}, x binary, codes binary, upper binary, lower binary"))
            kept.drop(before)
            entries = [b.entries.copy() for b in books]
            for r in _means(state, width):
                entries[r.entry // ENTRIES][r.entry % ENTRIES] = [int(r[f"t{i}"]) // r.n for i in range(width)]
            books = [Codebook(e, b.entries) for e, b in zip(entries, books)]
        coded = kept.keep(state.mapInArrow(_round(books, width, True), f"{named}, code string, error bigint"))
        numbers = ",".join(str(x) for p, b in enumerate(books) for e in b.entries for x in e[: max(0, min(width, length - p * width))])
        errors = kept.keep(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
        # a null label is a group like others
        key = F.coalesce(F.col("label").cast("string"), F.lit("")), F.col("label").isNull()
        by_label = kept.keep(errors.select(F.struct(*key).alias("key"), "label_error", "n"))
        out = split_join(coded.withColumn("key", F.struct(*key)), by_label, "key", "n")
        digest = hashlib.sha256(numbers.encode()).hexdigest()
        return cut(out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
