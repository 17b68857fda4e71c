"""Exact copies: counting quotient filters find fingerprints that occur twice, bytes decide.

Every task puts the fingerprints of its texts into counting quotient filters, one for each slice of the fingerprints'
range. A filter holds the upper bits of a fingerprint as a place and the rest as a sorted remainder, with its count in the
slots after it, and loses nothing; filters of a slice are merged by running through their remainders in order. Only texts
whose fingerprint has a count above one are compared, by grouping on all of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, few, split_join

#: Fingerprints that a task holds before it writes its filters.
HELD = 1 << 20
#: Bits of a fingerprint beyond those that number all rows: one text in 2^EXTRA is compared for nothing.
EXTRA = 16
#: Fingerprints of a slice, as bits: what a merging task holds.
SLICE = 18


def _digits(counts: np.ndarray, bits: int) -> np.ndarray:
    """How many slots of ``bits`` hold each count less one; none for a count of one."""
    left, n = counts - 1, np.zeros(len(counts), np.int64)
    while (left > 0).any():
        n += left > 0
        left = left >> bits
    return n


def build(prints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A filter of sorted, distinct fingerprints of ``bits`` bits and their counts.

    Head: slots, bits of a place, bits of a remainder. Then three bitmaps (places in use, slots that end a place's run,
    slots that hold a digit of a count) and the slots. A run starts at its place, or where the run before it ends.
    """
    place_bits = min(bits - 1, max(1, int(np.ceil(np.log2(len(prints) / 0.8)))))
    rest_bits = bits - place_bits
    place, rest = prints >> rest_bits, prints & ((1 << rest_bits) - 1)
    widths = 1 + _digits(counts, rest_bits)
    before = np.cumsum(widths) - widths
    at = before + np.maximum.accumulate(place - before)
    slots = int(max(at[-1] + widths[-1], 1 << place_bits))
    occupied, ends, digit = np.zeros(1 << place_bits, bool), np.zeros(slots, bool), np.zeros(slots, bool)
    occupied[place] = True
    last = np.append(place[1:] != place[:-1], True)
    ends[(at + widths - 1)[last]] = True
    held = np.zeros(slots, np.int64)
    held[at] = rest
    left, k = counts - 1, 1
    while (more := widths > k).any():
        digit[at[more] + k] = True
        held[at[more] + k] = left[more] & ((1 << rest_bits) - 1)
        left, k = left >> rest_bits, k + 1
    size = -(-rest_bits // 8)
    slots_bytes = held.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
    head = np.array([slots, place_bits, rest_bits], "<i8").tobytes()
    return head + b"".join(np.packbits(m).tobytes() for m in (occupied, ends, digit)) + slots_bytes


def entries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(sorted fingerprints, counts) that a filter holds."""
    slots, place_bits, rest_bits = (int(x) for x in np.frombuffer(data, "<i8", 3))
    at, maps = 24, []
    for n in (1 << place_bits, slots, slots):
        maps.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool))
        at += -(-n // 8)
    size = -(-rest_bits // 8)
    held = np.zeros((slots, 8), np.uint8)
    held[:, :size] = np.frombuffer(data, np.uint8, slots * size, at).reshape(slots, size)
    held = held.view("<i8").reshape(-1)
    places, ends, digit = np.flatnonzero(maps[0]), np.flatnonzero(maps[1]), maps[2]
    starts = np.maximum(places, np.append(-1, ends[:-1]) + 1)
    lengths = ends - starts + 1
    used = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    place, value, is_digit = np.repeat(places, lengths), held[used], digit[used]
    first = np.flatnonzero(~is_digit)
    counts = np.ones(len(first), np.int64)
    owner = np.cumsum(~is_digit) - 1
    digits = np.flatnonzero(is_digit)
    np.add.at(counts, owner[digits], value[digits] << (rest_bits * (digits - first[owner[digits]] - 1)))
    return (place[first] << rest_bits) | value[first], counts


def merge(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted fingerprints, counts) of several filters, whose places may be of different widths."""
    prints, counts = (np.concatenate(x) for x in zip(*map(entries, filters)))
    order = np.argsort(prints, kind="stable")  # runs that are sorted already
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[first], np.add.reduceat(counts, first)


def _filters(bits: int, slice_bits: int):
    """A task's fingerprints to (slice, filter)."""
    low = bits - slice_bits

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        prints, counts = np.unique(np.concatenate(held), return_counts=True)
        slices, first = np.unique(prints >> low, return_index=True)
        out = []
        for p, n in zip(np.split(prints & ((1 << low) - 1), first[1:]), np.split(counts, first[1:])):
            out.append(build(p, n.astype(np.int64), low))
        return pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array(out, pa.binary())], names=["slice", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b.column("print").to_numpy())
            n += b.num_rows
            if n >= HELD:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _repeated(low: int):
    def run(table: pa.Table) -> pa.Table:
        prints, counts = merge(table.column("filter").to_pylist())
        more = counts > 1
        whole = prints[more] | (table.column("slice")[0].as_py() << low)
        return pa.table({"print": pa.array(whole, pa.int64()), "n": pa.array(counts[more], pa.int64())})

    return run


def repeated(prints: DataFrame, bits: int, slice_bits: int) -> DataFrame:
    """(print, n): the fingerprints (``print``, of ``bits`` bits) that occur more than once, and how often."""
    filters = prints.select("print").mapInArrow(_filters(bits, slice_bits), "slice bigint, filter binary")
    return filters.groupBy("slice").applyInArrow(_repeated(bits - slice_bits), "print bigint, n bigint")


def normal(text: Column) -> Column:
    """The text without ASCII white space; a null one is empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def _told(sha: Column) -> Column:
    """What tells texts of one fingerprint apart, checked against their bytes."""
    return sha


def _classed(rows: DataFrame, keys: list[str], again: DataFrame, kept: Scratch) -> DataFrame:
    """The result for ``rows``, of which those equal in ``keys`` are copies."""
    candidates = rows.join(few(again.select("print")), "print", "left_semi")
    order = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = candidates.groupBy(*keys).agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
    key = F.struct(*keys)
    groups = kept.keep(groups.select(key.alias("key"), F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("best"), "n"))
    out = split_join(rows.withColumn("key", key), groups, "key", "n", "left")
    return out.select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), F.coalesce(F.col("row") == F.col("best"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of ``docs``.

    Texts are equal if they are without ASCII white space; null is empty, and empty texts equal each other. Of equal texts
    the row of most code points in the text as it is stays, then that of the smallest id, nulls last; of rows that are the
    same in both, one. keep_id is its id. Texts of any length and rows of other columns, whatever their names, are fine. An
    empty table gives no rows.
    """
    text = F.col(f"`{text_col}`").cast("string")
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), normal(text).alias("norm"), F.length(F.coalesce(text, F.lit(""))).alias("chars"))
    told = read.select("*", F.unhex(F.sha2("norm", 256)).alias("sha"), _hash(F.col("norm")).alias("hash"))
    with Scratch(docs.sparkSession) as kept:
        rows = kept.keep(told.select("doc_id", "chars", "sha", "hash", F.monotonically_increasing_id().alias("row")))
        need = max(1, rows.count()).bit_length()
        bits, slice_bits = min(64, need + EXTRA), max(4, need - SLICE)
        bits = min(bits, 62)  # sums of places and widths fit in a long
        upper = F.shiftrightunsigned("hash", 64 - bits).alias("print")
        rows = rows.select("doc_id", "chars", "sha", "row", upper, _told(F.col("sha")).alias("told"))
        again = kept.keep(repeated(rows, bits, slice_bits))
        # all bytes of texts of one fingerprint meet here, copies folded before they are shuffled
        routed = told.select("norm", upper, _told(F.col("sha")).alias("told")).join(few(again.select("print")), "print", "left_semi")
        texts = routed.groupBy("print", "told", "norm").agg(F.count("*").alias("copies"))
        doubtful = kept.keep(texts.groupBy("print", "told").agg(F.count("*").alias("texts")).where("texts > 1").select("print", "told"))
        if doubtful.isEmpty():
            return cut(_classed(rows, ["print", "told"], again, kept))
        clear = rows.join(few(doubtful), ["print", "told"], "left_anti")
        whole = told.select("doc_id", "chars", "sha", "norm", upper, _told(F.col("sha")).alias("told"))
        whole = kept.keep(whole.join(few(doubtful), ["print", "told"], "left_semi").withColumn("row", F.monotonically_increasing_id()))
        return cut(_classed(clear, ["print", "told"], again, kept).unionByName(_classed(whole, ["print", "norm"], again, kept)))
