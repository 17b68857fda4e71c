"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash candidates, then an exact check.

Texts whose SimHash fingerprints differ by two bits at most are found by deletion variants (``simhash.links``). At a
similarity of 0.8 fingerprints differ by ten bits on average, too many for segments, so that a text also has ``BANDS``
keys, each of ``ROWS`` least hashes; two texts of similarity s share a key with probability 1 - (1 - s^5)^24, 0.9999 at
0.8. Pairs of a key's texts are checked on their whole shingle sets. Where a key has more than ``dense`` texts, these are
checked against one of them, then against the one most like that, and so on for ``ROUNDS``, so that pairs don't grow with
the square of a group. Copies of one text with edits of their own are closer to those with few edits than to one another:
each round's text lies nearer the middle of its group. What is not in the key's largest component by then meets all other
texts of the key in blocks of shingle sets, so that no pair of a key is left out unless it is in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, few, keyed_texts
from .common import row_key as key_of
from .simhash import components, links, majority, shingle_hashes

BANDS = 24
ROWS = 5
#: Against how many of its texts, one after the other, a large key's others are checked before pairs are made of what is left.
ROUNDS = 4
#: Bytes of shingles of texts that meet others in one block.
BLOCK = 1 << 18
_r = np.random.default_rng(42)
_FLIP = _r.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _r.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes, as signed 64-bit integers."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 10):
        np.minimum(least, ((hashes[i : i + (1 << 10)] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(rows)], np.uint64).view(np.int64)


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sorted sets of 64-bit hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both / max(1, len(x) + len(y) - both)


def _binary(column: pa.Array) -> Iterator[bytes | None]:
    """One value at a time; a batch's words at once would take hundreds of MB."""
    return (x.as_py() for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _blocks_met(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of texts (l, r), as few as join what pairs of different roots and this similarity join."""
    for b in batches:
        for k in range(b.num_rows):
            left, right = b.column("l")[k].as_py(), b.column("r")[k].as_py()
            sets = [np.frombuffer(x["grams"], np.uint64) for x in left + right]
            ends = np.cumsum([len(x) for x in sets])
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
            cut_at = ends[len(left) - 1]
            others, sizes = ids[cut_at:], np.array([len(x) for x in sets[len(left) :]])
            starts, roots = np.cumsum(sizes) - sizes, np.array([x["root"] for x in right])
            have, head, out = np.zeros(ids.max() + 1, bool), {}, []

            def top(x: int) -> int:
                while head.get(x, x) != x:
                    head[x] = x = head.get(head[x], head[x])
                return x

            for i, x in enumerate(left):
                own = ids[ends[i] - len(sets[i]) : ends[i]]
                have[own] = True
                both = np.add.reduceat(have[others].astype(np.int64), starts)
                have[own] = False
                for j in np.flatnonzero((both / (len(own) + sizes - both) >= similarity) & (roots != x["root"])):
                    u, v = top(x["root"]), top(right[j]["root"])
                    if u != v:
                        head[u] = v
                        out.append((x["node"], right[j]["node"]))
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], names=["a", "b"])


def _left_over(left: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join the components of ``left`` (g, node, root, grams) further, within g.

    Texts outside of a group's largest component meet all of the group; blocks are dealt over tasks by both of their numbers.
    """
    per = left.groupBy("g", "root").agg(F.count("*").alias("n"), F.sum(F.length("grams")).alias("size"))
    per = per.groupBy("g").agg(F.sum("size").alias("size"), F.max(F.struct("n", "root", "size")).alias("top"))
    blocks = lambda size: F.ceil(size / BLOCK)
    per = per.select("g", F.col("top.root").alias("main"), blocks(F.col("size")).alias("js"), blocks(F.col("size") - F.col("top.size")).alias("is")).where("is > 0")
    rows = left.join(few(cut(per)), "g")
    one = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    texts = F.collect_list(F.struct("node", "root", "grams"))
    lone = rows.where("root <> main").groupBy("g", one("is").alias("i"), "js").agg(texts.alias("l")).select("g", "i", "l", every("js").alias("j"))
    rest = rows.groupBy("g", one("js").alias("j"), "is").agg(texts.alias("r")).select("g", "j", "r", every("is").alias("i"))
    met = lone.join(rest, ["g", "i", "j"]).select("l", "r")
    return met.mapInArrow(lambda batches: _blocks_met(batches, similarity), "a bigint, b bigint")


def near_copies(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, dense: int = 48, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, component_id, row_key): one row for each row of ``docs``.

    component_id: the smallest doc_id reachable over pairs of texts whose sets of ``shingle``-word shingles have at
    least this similarity. Words are separated by ASCII white space, A-Z are lower-cased; fewer than ``shingle`` words
    make one shingle of all; null texts and texts without words are copies of each other. Ids that are null take part
    but never give a component its id unless all of its ids are null. Repeated rows are kept. An empty table gives no
    rows.
    """
    base = keyed_texts(docs, id_col, text_col).withColumn("row_key", key_of())
    kind = base.schema["doc_id"].dataType.simpleString()

    none = np.zeros(0, np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, keys, fp = [], [], []
            for words in map(words_of, _binary(b.column("text"))):
                node.append(xxhash.xxh64_intdigest(b" ".join(words)))
                hashes = shingle_hashes(words, shingle) if words else none
                keys.append(band_keys(hashes) if words else none)
                fp.append(majority(hashes) if words else 0)
            node = np.array(node, np.uint64).view(np.int64)
            cols = [b.column("doc_id"), b.column("row_key"), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fp, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row_key", "node", "keys", "fp"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(words_of(t), shingle)).tobytes() for t in _binary(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(found, pa.binary())], names=["node", "grams"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = pa.array([jaccard(x.as_py(), y.as_py()) for x, y in zip(b.column("x"), b.column("y"))], pa.float64())
            yield b.select(["a", "b"]).append_column("s", same)

    read_in = cut(base.mapInArrow(read, f"doc_id {kind}, row_key bigint, node bigint, keys array<bigint>, fp bigint"))
    rows = read_in.select("doc_id", "row_key", "node")
    # one row stands for all copies of a text
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"), F.min("row_key").alias("row_key")))
    # what follows is written, so that small tables are read in few tasks and joined without a shuffle, and goes at the end
    with Scratch(docs.sparkSession) as kept:
        keyed = kept.keep(read_in.select("node", F.explode("keys").alias("key")).distinct())
        sizes = kept.keep(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        small = keyed.join(sizes.where(F.col("n") <= dense).select("key"), "key")
        twins = small.alias("l").join(small.alias("r"), "key").where("l.node < r.node")
        # of texts that share a fingerprint one meets those of the fingerprints within two bits
        prints = kept.keep(read_in.select("node", "fp").distinct())
        heads = kept.keep(prints.groupBy("fp").agg(F.min("node").alias("head")))
        near = kept.keep(links(heads.select("fp")))
        close = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a")
        close = close.join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
        same = prints.join(heads, "fp").where("node <> head")
        pairs = twins.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).union(close.select(*_ordered("x", "y"))).union(same.select(*_ordered("node", "head")))
        pairs = kept.keep(pairs.distinct())
        hot = kept.keep(keyed.join(few(sizes.where(F.col("n") > dense).select("key")), "key"))
        kept.drop(keyed)
        large = not hot.isEmpty()
        met = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        met = (met.union(hot.select("node")) if large else met).distinct()
        wanted = few(kept.keep(nodes.join(met, "node", "left_semi").select("row_key", "node")))
        grams = base.join(wanted, "row_key").select("node", "text").mapInArrow(sets, "node bigint, grams binary")
        grams = kept.keep(grams.dropDuplicates(["node"]))

        def scored_of(pairs: DataFrame) -> DataFrame:
            sided = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
            sided = sided.join(grams.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
            return kept.keep(sided.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint, s double"))

        alike = lambda scored: scored.where(F.col("s") >= similarity).select("a", "b")
        edges = alike(scored_of(pairs))
        # the first texts are drawn by a hash that is the same for all keys, so that keys of one group draw the same ones
        drawn = F.min(F.struct(F.xxhash64("node"), "node"))["node"]
        pivots = kept.keep(hot.groupBy("key").agg(drawn.alias("pivot")).withColumn("used", F.array("pivot"))) if large else None
        groups = None if pivots is None else pivots.select("key", F.col("pivot").alias("g"))
        for _ in range(ROUNDS if large else 0):
            tried = hot.join(few(pivots), "key").where(~F.array_contains("used", F.col("node"))).select("key", "node", "pivot", "used", *_ordered("node", "pivot"))
            scored = scored_of(tried.select("a", "b").distinct())
            edges = edges.unionByName(alike(scored))
            next_one = F.max_by("node", F.struct("s", F.xxhash64("node"))).alias("pivot")
            best = tried.join(scored, ["a", "b"]).groupBy("key", "used").agg(next_one)
            pivots = kept.keep(best.withColumn("used", F.concat("used", F.array("pivot"))))
        roots = components(edges)
        member = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
        if large:
            # keys whose first text is the same make one group: more pairs than those of its keys, and each of them once
            left = hot.join(few(groups), "key").select("g", "node").distinct().join(kept.keep(member), "node", "left")
            left = left.select("g", "node", F.coalesce("root", "node").alias("root")).join(grams, "node")
            new = kept.keep(_left_over(kept.keep(left), similarity))
            if not new.isEmpty():
                known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
                roots = components(new.unionByName(known))
                member = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
    ids = member.join(nodes, "node").select("node", "root", "low")
    linked = ids.join(ids.groupBy("root").agg(F.min("low").alias("component")), "root").select("node", "component")
    table = nodes.join(linked, "node", "left").select("node", "rows", F.coalesce("component", "low").alias("component_id"))
    table = cut(table)
    # nodes with more than a 5,000th of the rows are under 5,000; their rows stay where they are
    total = nodes.agg(F.sum("rows")).first()[0] or 0
    common = F.col("rows") > max(50, total // 5000)
    often, seldom = F.broadcast(table.where(common)), table.where(~common)
    rest = rows.join(often.select("node"), "node", "left_anti").join(seldom, "node")
    return rows.join(often, "node").unionByName(rest).select("doc_id", "component_id", "row_key")
