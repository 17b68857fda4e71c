"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of an item is a seed. A seed that edits destroyed matches nothing, so that choosing among them by document
counts could pass over those that an edited copy still holds; what keeps them rare is that both texts must have one near
the same diagonal. Documents meet items on seeds, one of which is enough; around each the document's words are aligned
with the item in a band of diagonals: +1 for a match, -1 for a mismatch or a gap. Bands in which too few of the item's
words occur to reach the least score are left out first. Items of many words are aligned in overlapping segments, so
that work grows with the seeds met and never with the square of a length. Benchmarks above ``block_bytes`` are taken in
blocks, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts
from .common import row_key as key_of

GAP = 1
#: Diagonals of a band; bands begin a third of that apart, so that a seed is 16 diagonals from either edge at least.
BAND, STEP = 48, 16
#: Words of an item's segment, and those before and after it that are aligned with it.
SEGMENT, MARGIN = 512, 128
#: Seeds met that are expanded at once, and bands that are aligned at once.
EXPANDED, ALIGNED = 1 << 20, 512
_NOT_WORD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation; none of a null."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_NOT_WORD).split() if text else []


def least_score(size: int) -> int:
    """Alignment score from which a passage is a copy of an item of ``size`` words: 10 words net, or 70 % of fewer."""
    return min(10, max(-(-7 * size // 10), min(size, 6)))


class Items:
    """A block of benchmark items as arrays, with the n-grams that occur in them, all of which are seeds."""

    def __init__(self, rows: list[tuple], n: int = 3):
        self.n, self.ids = n, [r[0] for r in rows]
        words = [words_of(r[1]) for r in rows]
        self.vocab = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}), 1)}
        self.words = [np.array([self.vocab[w] for w in ws], np.int64) for ws in words]
        codes = [self.codes(w) for w in self.words]
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.seeds, first = np.unique(code[order], return_index=True)
        self.of_seed = np.append(first, len(order))
        self.seed_item, self.seed_place = item[order], place[order]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.least = np.array([least_score(x) for x in self.sizes], np.int64)
        # which words an item has, as sorted (item, word)
        self.base = len(self.vocab) + 1
        self.has = np.unique(np.concatenate([i * self.base + w for i, w in enumerate(self.words)] or [np.zeros(0, np.int64)]))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Code of the n-gram that begins at each word."""
        size = max(0, len(ids) - self.n + 1)
        out = np.zeros(size, np.uint64)
        for k in range(self.n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + size].astype(np.uint64)
        return out

    def hits(self, ids: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ids`` where one of ``grams`` (sorted) begins, and its index. 0 is no word of the benchmark."""
        if len(grams) == 0 or len(ids) < self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids > 0
        size = len(ids) - self.n + 1
        whole = np.ones(size, bool)
        for k in range(self.n):
            whole &= known[k : k + size]
        at = np.flatnonzero(whole)
        code = np.zeros(len(at), np.uint64)
        for k in range(self.n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64)
        i = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
        found = grams[i] == code
        return at[found], i[found]

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of texts, joined with n zeros after each, and where each text begins."""
        parts, starts, at = [], [], 0
        gap = np.zeros(self.n, np.int64)
        for t in texts:
            ws = words_of(t)
            starts.append(at)
            parts += [np.fromiter(map(self.vocab.get, ws, repeat(0)), np.int64, len(ws)), gap]
            at += len(ws) + self.n
        return (np.concatenate(parts) if parts else gap[:0]), np.array(starts, np.int64)


def smith_waterman(items: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local scores of rows of ``items`` (padded with -1) in a band of rows of ``windows``, and the places in item and
    window they end at.

    Word i of an item meets words i to i + band - 1 of its window, which is as many words longer than the item. The left
    neighbour's share is a running maximum of score plus gaps so far, so that a whole row is made at once.
    """
    n, longest = items.shape
    width = windows.shape[1] - longest
    ramp = GAP * np.arange(width, dtype=np.int32)
    h = np.zeros((n, width + 1), np.int32)  # by diagonal; the last stays 0
    best, at_item, at_window = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(int(sizes.max(initial=0))):
        same = windows[:, i : i + width] == items[:, i : i + 1]
        # the same diagonal, or the one above: an item's word that the window lacks
        new = np.maximum(h[:, :-1] + np.where(same, 1, -1), h[:, 1:] - GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp
        new[i >= sizes] = 0
        h[:, :-1] = new
        top = new.max(axis=1)
        better = np.flatnonzero(top > best)
        best[better], at_item[better], at_window[better] = top[better], i, i + new[better].argmax(axis=1)
    return best, at_item, at_window


def _bands(block: Items, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(text, item, band, segment) rows in which a seed lies."""
    at, seed = block.hits(ids, block.seeds)
    each = block.of_seed[seed + 1] - block.of_seed[seed]
    parts, upto = [np.zeros((0, 4), np.int64)], np.cumsum(each)
    first = 0
    while first < len(at):  # a seed at many places of many texts is expanded in parts
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + EXPANDED, "right")))
        n, s = each[first:last], seed[first:last]
        k = np.repeat(block.of_seed[s], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos = np.repeat(at[first:last], n)
        text = np.searchsorted(starts, pos, "right") - 1
        diagonal = pos - block.seed_place[k] - starts[text]
        rows = np.stack([text, block.seed_item[k], (diagonal + STEP // 2) // STEP, block.seed_place[k] // SEGMENT], 1)
        parts.append(np.unique(rows, axis=0))
        first = last
    return np.unique(np.concatenate(parts), axis=0)


def _align(block: Items, ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, score, first word, last word) of the best passage of each text and item that has one."""
    bands = _bands(block, ids, starts)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    ends = np.append(starts[1:], len(ids)) - block.n
    bands = bands[np.argsort(block.sizes[bands[:, 1]], kind="stable")]
    for a in range(0, len(bands), ALIGNED):
        text, item, band, segment = bands[a : a + ALIGNED].T
        first = np.maximum(0, segment * SEGMENT - MARGIN)
        sizes = np.minimum(block.sizes[item], (segment + 1) * SEGMENT + MARGIN) - first
        longest = int(sizes.max())
        low = first + band * STEP - BAND // 2
        span = low[:, None] + np.arange(longest + BAND)
        inside = (span >= 0) & (span < (ends - starts)[text][:, None]) & (np.arange(longest + BAND) < sizes[:, None] + BAND)
        windows = np.where(inside, ids[np.where(inside, span, 0) + starts[text][:, None]], 0)
        # no alignment scores more than there are words of the item
        key = item[:, None] * block.base + windows
        known = block.has[np.minimum(np.searchsorted(block.has, key), len(block.has) - 1)] == key
        able = np.flatnonzero(((windows > 0) & known).sum(axis=1) >= block.least[item])
        if not len(able):
            continue
        text, item, first, sizes, low, windows = (x[able] for x in (text, item, first, sizes, low, windows))
        items = np.full((len(able), longest), -1, np.int64)
        for r, (i, f, n) in enumerate(zip(item, first, sizes)):
            items[r, :n] = block.words[i][f : f + n]
        score, at_item, at_window = smith_waterman(items, sizes, windows)
        for r in np.flatnonzero(score >= block.least[item]):
            key, top = (int(text[r]), int(item[r])), int(score[r])
            if key not in found or top > found[key][0]:
                last = int(low[r]) + int(at_window[r])
                found[key] = (top, last - _reach(items[r], windows[r], int(at_item[r]), int(at_window[r])), last)
    return [(t, i, *v) for (t, i), v in sorted(found.items())]


def _reach(item: np.ndarray, window: np.ndarray, at_item: int, at_window: int) -> int:
    """How many words before its last one the best alignment begins: the same backwards, in the same band."""
    shift = BAND - 1 - (at_window - at_item)  # the band's last diagonal becomes its first
    words = window[: at_window + 1 + shift][::-1].copy()
    words[:shift] = 0  # what comes after the end
    back = item[: at_item + 1][::-1]
    _, _, stop = smith_waterman(back[None, :], np.array([len(back)]), np.pad(words, (0, len(back) + BAND - len(words)))[None, :])
    return int(stop[0]) - shift


def _chunks(batch: pa.RecordBatch, rows: int = 512) -> Iterator[tuple[int, list[str | None]]]:
    for a in range(0, batch.num_rows, rows):
        yield a, batch.column("text").slice(a, rows).to_pylist()


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks of about ``block_bytes``; a block is what the driver and each task hold."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = [tuple(r) for r in part.where("text is not null").collect()]
        yield sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def matches(
    docs: DataFrame, benchmark: DataFrame, n: int = 3, block_bytes: int = 16 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, score, similarity, start_word, end_word, row_key): passages of items in documents.

    One row, of the best passage, for each row of ``docs`` and row of ``benchmark`` that share one; words count from 0,
    both ends inclusive; similarity is score over the item's words, of which a passage holds at most those of a segment.
    Null and empty texts on either side match nothing; items of under ``n`` words neither: they are no passage. Repeated
    rows are reported each. Empty tables give no rows.
    """
    base = keyed_texts(docs, id_col, text_col).withColumn("row_key", key_of())
    test = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    id_type, item_type = (x.dataType.simpleString() for x in (base.schema["doc_id"], test.schema["item_id"]))
    schema = f"doc_id {id_type}, item_id {item_type}, score int, similarity double, start_word bigint, end_word bigint, row_key bigint"
    item_arrow = pa.int64() if item_type == "bigint" else None
    sc, out = docs.sparkSession.sparkContext, None
    for rows in _blocks(test, block_bytes):
        block = Items(rows, n)
        chosen = sc.broadcast(block)

        def align(batches: Iterator[pa.RecordBatch], shared=chosen) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in batches:
                found = []
                for a, texts in _chunks(batch):
                    found += [(a + t, *x) for t, *x in _align(b, *b.read(texts))]
                own = pa.array([x[0] for x in found], pa.int64())
                similar = [x[2] / len(b.words[x[1]]) for x in found]
                cols = [
                    batch.column("doc_id").take(own), pa.array([b.ids[x[1]] for x in found], item_arrow),
                    pa.array([x[2] for x in found], pa.int32()), pa.array(similar, pa.float64()),
                    pa.array([x[3] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.int64()),
                    batch.column("row_key").take(own),
                ]
                if found:
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "score", "similarity", "start_word", "end_word", "row_key"])

        got = base.mapInArrow(align, schema)
        out = got if out is None else out.unionByName(got)
    return out
