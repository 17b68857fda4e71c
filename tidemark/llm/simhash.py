"""SimHash near-duplicates through deletion-variant signatures.

With ``max_bits`` = 2 differing bits and two 32-bit segments, one segment differs by at most one bit. Each
fingerprint is therefore indexed under its one-wildcard variants (segment, wildcard position, segment with that
bit cleared): 64 equality keys find every pair that can link. A bucket of at most ``dense`` fingerprints has its
pairs verified; members of larger buckets are instead keyed by all two-wildcard variants of the whole
fingerprint, under each of which there are at most four, any two of them linked. Both ways list every link, of which a
fingerprint can have 2,080. Links join distinct fingerprints; copies follow theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_key, cut, drop_rows, free_name, keyed_texts
from .common import row_key as key_of

BITS = 64
SEGMENT = 32


def shingle_hashes(words: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles; fewer than ``shingle`` words make one shingle of all."""
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest, stops = xxhash.xxh64_intdigest, ends[shingle - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of one text, as a signed 64-bit integer.

    Words are separated by ASCII white space, A-Z are lower-cased; fewer than ``shingle`` words make one shingle of
    all; no words (or null) give 0.
    """
    words = text.lower().split() if text else []
    return majority(shingle_hashes(words, shingle, seed)) if words else 0


def majority(h: np.ndarray) -> int:
    """The bits set in over half of some hashes, as a signed 64-bit integer."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(h)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, row_key): one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            text = text.cast(pa.binary() if text.type == pa.string() else pa.large_binary())
            fp = pa.array((fingerprint(t.as_py(), shingle) for t in text), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), fp, b.column("row_key")], names=["doc_id", "fp", "row_key"])

    df = keyed_texts(docs, id_col, text_col).withColumn("row_key", key_of())
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, fp bigint, row_key bigint")


def _single_bits() -> list[int]:
    return [1 << i for i in range(BITS - 1)] + [-(1 << 63)]


def links(fps: DataFrame, dense: int = 48) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct ``fp`` that differ by at most two bits.

    ``dense`` is the size of a bucket from which its members take the second way; results don't depend on it.
    """
    one = F.array(*[F.lit(x) for x in _single_bits()])
    keyed = fps.select("fp", F.posexplode(one).alias("pos", "bit"))
    half = F.when(F.col("pos") < SEGMENT, F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))).otherwise(
        F.shiftrightunsigned("fp", SEGMENT)
    )
    wild = F.when(F.col("pos") < SEGMENT, F.col("bit")).otherwise(F.shiftrightunsigned("bit", SEGMENT))
    # 32 bits of segment below, the wildcard's position above: one long is the whole key
    key = half.bitwiseAND(F.bitwise_not(wild)).bitwiseOR(F.shiftleft(F.col("pos").cast("bigint"), SEGMENT))
    keyed = keyed.select(key.alias("key"), "fp")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = cut(sizes)
    shared = keyed.join(sizes, "key")
    small = shared.where(F.col("n") <= dense).select("key", "fp")
    pairs = (
        small.alias("l")
        .join(small.alias("r"), "key")
        .where("l.fp < r.fp")
        .where(F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= 2)
        .select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    )
    hot = shared.where(F.col("n") > dense).select("fp").distinct()
    # fan out over tasks before each fingerprint becomes 2,016 keys
    i = hot.repartition("fp").select("fp", F.posexplode(one).alias("i", "bi"))
    two = i.select("fp", "i", "bi", F.posexplode(one).alias("j", "bj")).where("i < j")
    two = two.select(
        "fp", (F.col("i") * BITS + F.col("j")).alias("w"),
        F.col("fp").bitwiseAND(F.bitwise_not(F.col("bi").bitwiseOR(F.col("bj")))).alias("rest"),
    )
    # under a two-wildcard key there are at most four fingerprints
    cliques = (
        two.groupBy("w", "rest")
        .agg(F.collect_set("fp").alias("m"))
        .where(F.size("m") > 1)
        .select("m", F.explode("m").alias("a"))
        .select("a", F.explode("m").alias("b"))
        .where("a < b")
    )
    return pairs.union(cliques).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al. 2014), each round written, so that the next reads it in as few tasks as
    it needs. A hub's neighbours are only aggregated to their minimum and joined back, never gathered into one row. Between
    two rounds there are no more rows than edges, and twice as many before the last step. Rounds end when edges stay the same.
    """
    with Scratch(edges.sparkSession) as kept:
        e = kept.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
        before = None
        while True:
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            down = large.groupBy("u").agg(F.min("v").alias("m"))
            ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
            last, e = e, kept.keep(large.join(down, "u").select(ends.alias("e")).select("e.*").where("u <> v").distinct())
            kept.drop(last)
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
        return cut(e.select(F.col("u").alias("node"), F.col("v").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = 48) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links, row_key): one row for each row of ``docs``.

    component_id: the smallest doc_id reachable over links of at most two bits. n_links: how many other fingerprints
    the document's is linked to. Null texts and texts without words have fingerprint 0; ids that
    are null take part but never give a component its id unless all of its ids are null. Repeated rows are kept. An
    empty table gives no rows.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")))
    edges = cut(links(nodes.select("fp"), dense))
    # the nodes of edges as fingerprints; the root only has to name the component
    roots = components(edges)
    member = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
    ids = member.join(nodes, member.node == nodes.fp).select("node", "root", "low")
    of_root = ids.groupBy("root").agg(F.min("low").alias("component"))
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = ids.join(of_root, "root").join(degree, "node").select("node", "component", "n_links")
    table = nodes.join(linked, nodes.fp == F.col("node"), "left").select(
        "fp", "rows", F.coalesce("component", "low").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    table = cut(table)
    # fingerprints with more than a 5,000th of the rows are under 5,000; their rows stay where they are
    total = nodes.agg(F.sum("rows")).first()[0] or 0
    common = F.col("rows") > max(50, total // 5000)
    often, seldom = F.broadcast(table.where(common)), table.where(~common)
    rest = fps.join(often.select("fp"), "fp", "left_anti").join(seldom, "fp")
    out = fps.join(often, "fp").unionByName(rest)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links", "row_key")


def keep_representatives(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of ``rows`` (from ``near_duplicates``): one of its smallest id.

    Rows are dropped by id and key; where a kept row is there more than once, equal in id and text, one of them stays.
    """
    by = ["component_id", "doc_id", "row_key"]
    groups = cut(rows.groupBy(*by).agg(F.count("*").alias("n")))
    # of equal smallest ids the smaller key; a component whose ids are all null is one of its own
    best = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("b"))
    best = best.select(F.col("component_id").alias("c"), F.col("b.doc_id").alias("best_id"), F.col("b.row_key").alias("best"))
    told = groups.join(best, F.col("component_id").eqNullSafe(F.col("c")))
    told = cut(told.withColumn("chosen", (F.col("row_key") == F.col("best")) & F.col("doc_id").eqNullSafe(F.col("best_id"))))
    kept = drop_rows(docs, told.where("not chosen"), id_col, text_col)
    again = told.where("chosen and n > 1").select("doc_id", "row_key")
    if again.isEmpty():
        return kept
    single = drop_rows(kept, again, id_col, text_col)
    name = free_name(docs, "row_key")
    twice = by_key(kept, again, "left_semi", id_col, text_col).withColumn(name, key_of(id_col, text_col))
    return single.unionByName(twice.dropDuplicates([id_col, name]).drop(name))
