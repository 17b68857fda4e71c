"""Best-fit packing of documents into sequences, improved by swap-based local search.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths, at most ``capacity``
counts whatever the input, reaches the driver. There bins are held as classes: a pattern (lengths in a bin) and how
many bins have it. Best-fit decreasing fills classes; local search then moves one document, or exchanges one for one
or two for one, from an emptier into a fuller underfull bin, which raises the sum of squared fills, until the emptiest
bins vanish; where it is stuck it starts again from a few bins dealt anew. The result is a table of (length, rank from,
first bin, offset), at most 44 distinct lengths a class; pieces find their place in it by their rank among the pieces
of their length. Pieces of full length need no partner and are sequences of their own, numbered where they are.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keyed_texts

CAPACITY = 1024
Pattern = tuple[int, ...]


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[Pattern, int]:
    """Best-fit decreasing over a histogram of lengths: bins as {pattern: count}."""
    by_free: dict[int, dict[Pattern, int]] = defaultdict(dict)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            free = next((f for f in range(size, capacity) if by_free.get(f)), None)
            if free is None:
                pattern, bins, room = (), left, capacity
            else:
                pattern, bins = by_free[free].popitem()
                room = free
            each = room // size
            whole = min(bins, left // each)
            rest = min(bins - whole, 1) * min(left - whole * each, each)
            for count, n in ((whole, each), (1 if rest else 0, rest)):
                if count:
                    new = pattern + (size,) * n
                    slot = by_free[room - n * size]
                    slot[new] = slot.get(new, 0) + count
            unused = bins - whole - (1 if rest else 0)
            if free is not None and unused:
                by_free[free][pattern] = by_free[free].get(pattern, 0) + unused
            left -= whole * each + rest
    out: Counter[Pattern] = Counter()
    for patterns in by_free.values():
        out.update(patterns)
    return dict(out)


@functools.lru_cache(maxsize=1 << 16)
def _takeable(items: Pattern) -> tuple[Pattern, ...]:
    """What can be taken from a bin: nothing, one document or two."""
    distinct = sorted(set(items))
    twice = [(x, x) for x in distinct if items.count(x) > 1]
    return ((), *[(x,) for x in distinct], *combinations(distinct, 2), *twice)


class _Underfull:
    """What underfull bins could give in an exchange, as rows of arrays; the rows of bins that are gone stay dead."""

    def __init__(self, capacity: int):
        self.capacity, self.at, self.own = capacity, {}, []
        self.table = np.zeros((5, 1024), np.int64)  # sum, documents, free room, fill, alive

    def add(self, pattern: Pattern) -> None:
        if pattern in self.at or sum(pattern) == self.capacity:
            return
        gives, first = _takeable(pattern), len(self.own)
        while first + len(gives) > self.table.shape[1]:
            self.table = np.hstack([self.table, np.zeros_like(self.table)])
        end, fill = first + len(gives), sum(pattern)
        self.own += [(pattern, g) for g in gives]
        self.table[:2, first:end] = [[sum(g) for g in gives], [len(g) for g in gives]]
        self.table[2:, first:end] = [[self.capacity - fill], [fill], [1]]
        self.at[pattern] = slice(first, end)

    def drop(self, pattern: Pattern) -> None:
        if own := self.at.pop(pattern, None):
            self.table[4, own] = 0

    def best(self, low: Pattern, alone: bool) -> tuple[Pattern, Pattern, Pattern] | None:
        """(taken, other bin, given back): the exchange that moves most from ``low`` into a bin at least as full: a
        move, or at most two documents for one. None if none moves anything."""
        sums, many, free, fill, alive = self.table[:, : len(self.own)]
        able = (alive > 0) & (fill >= sum(low))
        if alone:
            able[self.at[low]] = False
        top, out = 0, None
        for taken in _takeable(low)[1:]:
            gain = sum(taken) - sums
            fits = able & (gain > top) & (gain <= free) & (many <= 2 if len(taken) == 1 else many == 1)
            if fits.any():
                i = int(np.argmax(np.where(fits, gain, 0)))
                top, out = int(gain[i]), (taken, *self.own[i])
        return out


def _without(pattern: Pattern, out: Pattern, into: Pattern) -> Pattern:
    left = list(pattern)
    for x in out:
        left.remove(x)
    return tuple(sorted([*left, *into], reverse=True))


def local_search(bins: dict[Pattern, int], capacity: int = CAPACITY) -> dict[Pattern, int]:
    """Bins as {pattern: count} after all exchanges that raise the sum of squared fills, the emptiest bins first.

    Every exchange moves tokens from one underfull bin into another at least as full, so that the sum of squares rises
    and the search ends: when no pair of bins has an exchange left, or bins are as few as the total needs.
    """
    bins = dict(bins)
    excess = sum(bins.values()) - _least(bins, capacity)
    under = _Underfull(capacity)
    for p in bins:
        under.add(p)
    stuck: set[Pattern] = set()
    while excess > 0:
        low = min((p for p in under.at if p not in stuck), key=lambda p: (sum(p), p), default=None)
        if low is None:
            break
        found = under.best(low, bins[low] < 2)
        if found is None:
            stuck.add(low)
            continue
        taken, full, back = found
        n = bins[low] // 2 if low == full else min(bins[low], bins[full])
        for p in (low, full):
            bins[p] -= n
            if not bins[p]:
                del bins[p]
                under.drop(p)
        for p in (_without(low, taken, back), _without(full, back, taken)):
            if p:
                bins[p] = bins.get(p, 0) + n
                under.add(p)
            else:
                excess -= n
        stuck.clear()
    return bins


def _least(bins: dict[Pattern, int], capacity: int) -> int:
    """How many bins the total needs at least."""
    return -(-sum(sum(p) * n for p, n in bins.items()) // capacity)


def _dealt(items: list[int], capacity: int) -> dict[Pattern, int]:
    """Best fit of items in the order given."""
    bins: list[list[int]] = []
    for x in items:
        room = [(sum(b), i) for i, b in enumerate(bins) if sum(b) + x <= capacity]
        if room:
            bins[max(room)[1]].append(x)
        else:
            bins.append([x])
    return dict(Counter(tuple(sorted(b, reverse=True)) for b in bins))


def _score(bins: dict[Pattern, int]) -> tuple[int, int]:
    return -sum(bins.values()), sum(sum(p) ** 2 * n for p, n in bins.items())


def improve(bins: dict[Pattern, int], capacity: int = CAPACITY, starts: int = 6_000, seed: int = 1) -> dict[Pattern, int]:
    """Local search, then ``starts`` new starts of it from places nearby, or until bins are as few as the total needs.

    A start takes a class of underfull bins, every other time the emptiest, and a few drawn among those with as many bins;
    it deals the documents of one bin of each by best fit, in a slightly shuffled decreasing order, and searches among
    them. The result stands, for all bins of these classes at once, if it is of fewer bins, or of as many with a sum of
    squares no lower. A start costs the same whatever the input, as the classes do not grow with it.
    """
    bins = local_search(bins, capacity)
    least, r = _least(bins, capacity), random.Random(seed)
    full = sorted(p for p in bins if sum(p) == capacity)
    under = sorted((sum(p), p) for p in bins if sum(p) < capacity)
    total = sum(bins.values())
    for start in range(starts):
        if total <= least or not under:
            break
        first = under[0 if start % 2 else r.randrange(len(under))][1]
        k = r.choice((4, 8, 16))
        chosen = {p for _, p in (*under[:1], *r.sample(under, min(k, len(under))))}
        chosen = {first} | {p for p in (*sorted(chosen), *r.sample(full, min(k // 2, len(full)))) if bins[p] >= bins[first]}
        items = sorted((x for p in sorted(chosen) for x in p), key=lambda x: (r.randint(0, 60) - x, x))
        old = dict.fromkeys(chosen, 1)
        new = local_search(_dealt(items, capacity), capacity)
        if new == old or _score(new) < _score(old):
            continue
        times = bins[first]
        for change, sign in ((old, -times), (new, times)):
            for p, n in change.items():
                before = bins.get(p, 0)
                after = before + sign * n
                if after:
                    bins[p] = after
                else:
                    del bins[p]
                if (not before) != (not after):
                    where, key = (full, p) if sum(p) == capacity else (under, (sum(p), p))
                    at = bisect_left(where, key)
                    where[at : at + (not after)] = [key] * (not before)
        total -= (sum(old.values()) - sum(new.values())) * times
    return bins


def places(bins: dict[Pattern, int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: ranks at which a segment starts, its first bin, how many of the length a bin has, their offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: Counter[int] = Counter()
    first = 0
    for pattern in sorted(bins, reverse=True):
        at = 0
        for size, each in sorted(Counter(pattern).items(), reverse=True):
            rows[size].append((ranks[size], first, each, at))
            ranks[size] += each * bins[pattern]
            at += size * each
        first += bins[pattern]
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in rows.items()}


#: Characters outside scripts long in Unicode, a few marks apart.
_ODD = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")


@functools.cache
def _tokenizer(path: str):
    """The tokenizer of a file, once a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _special(path: str) -> tuple[str, ...]:
    """Strings that the tokenizer of a file takes as one token wherever they stand."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", ()))


@functools.cache
def _rank_encoding(path: str):
    """The encoding of a rank file, once a process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


class Encoder:
    """Token ids by a byte-level BPE file, as its tokenizer gives them without added ones, and the id that ends a
    document.

    The rank file gives the same ids faster. Texts with one of the tokenizer's special strings, and those with
    characters outside scripts long in Unicode, whose classes differ between libraries' tables, are left to the
    tokenizer itself, which is only loaded for them.
    """

    def __init__(self, path: str, ranks: str | None, end: int = 2):
        self.path, self.ranks, self.end = path, ranks, end

    def __call__(self, text: str) -> np.ndarray:
        if self.ranks and not _ODD.search(text) and not any(t in text for t in _special(self.path)):
            ids = _rank_encoding(self.ranks).encode_ordinary(text)
        else:
            ids = _tokenizer(self.path).encode(text, add_special_tokens=False).ids
        ids.append(self.end)
        return np.array(ids, np.uint32)


def public_encoder() -> Encoder:
    import public_tokenizers as p

    return Encoder(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"))


def pieces(docs: DataFrame, encoder: Encoder, capacity: int = CAPACITY, with_ids: bool = True,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a longer document's first piece takes what is over.

    ids_crc32 is over the piece's ids as little-endian unsigned 32-bit numbers. A null text counts as empty.
    """
    df = keyed_texts(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, piece, start, length, crc, all_ids = [], [], [], [], [], []
            for row, text in enumerate(b.column("text")):
                ids = encoder(text.as_py() or "")
                head = len(ids) % capacity or min(capacity, len(ids))
                for k, end in enumerate(range(head, len(ids) + 1, capacity)):
                    at = max(0, end - capacity) if k else 0
                    part = ids[at:end]
                    which.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                    if with_ids:
                        all_ids.append(part.astype(np.int64))
            cols = [b.column("doc_id").take(pa.array(which, pa.int64())), pa.array(piece, pa.int32())]
            cols += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            if with_ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, schema)


def pack(docs: DataFrame, encoder: Encoder | None = None, capacity: int = CAPACITY, with_ids: bool = True,
         salt_rows: int = 100_000, starts: int = 6_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): one row for each piece of a document.

    Pieces of a length are numbered in parts of about ``salt_rows``, so that no common length meets in one task; those
    of full length are numbered without a shuffle. ``starts``: see ``improve``. Repeated rows are packed each on its
    own. A null or empty text is its end token alone. An empty table gives no rows.
    """
    rows = cut(pieces(docs, encoder or public_encoder(), capacity, with_ids, id_col, text_col))
    keep = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most capacity rows
    whole = histogram.pop(capacity, 0)
    bins = improve(best_fit(histogram, capacity), capacity, starts)
    alone = rows.where(F.col("length") == capacity) if whole else None
    if alone is not None:
        number = F.monotonically_increasing_id() + F.lit(sum(bins.values()))
        alone = alone.select(*keep, number.alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
        if not histogram:
            return alone
    # the row's number in the checkpoint deals equal rows to different salts too
    salts = F.array(*[F.lit(-(-histogram.get(size, 1) // salt_rows)) for size in range(capacity)])
    parted = rows.withColumn("number", F.monotonically_increasing_id()).where(F.col("length") < capacity)
    parted = parted.withColumn("salt", F.pmod("number", F.get(salts, F.col("length").cast("int"))).cast("int"))
    counts = parted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0))))
    within = Window.partitionBy("length", "salt").orderBy("number")
    # a row a length, and one for each salt_rows pieces, are broadcast
    ranked = parted.withColumn("row", F.row_number().over(within) - 1).join(F.broadcast(counts), ["length", "salt"])
    ranked = ranked.select(*keep, (F.col("from") + F.col("row")).alias("rank"))
    table = docs.sparkSession.sparkContext.broadcast(places(bins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                start, first, each, at = table.value[int(size)]
                k = np.searchsorted(start, rank[own], "right") - 1
                place = rank[own] - start[k]
                bins[own] = first[k] + place // each[k]
                offset[own] = at[k] + size * (place % each[k])
            cols = [*[b.column(c) for c in keep], pa.array(bins), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "sequence_id", "offset"])

    out = ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")
    return out if alone is None else out.unionByName(alone)
