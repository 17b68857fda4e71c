"""The prefix trie of conversations, rolled up by pointer jumping.

Every turn becomes a digest of (place, role, text); running sums of the digests' words name each prefix, whatever
conversation it stands in, so that equal prefixes meet under one key and a node's parent edge is a key too. What a
node's subtree holds is then summed in rounds: in round k each node hands what it has gathered to its ancestor 2^k above
and takes over that one's pointer. A trie of depth d takes about log2(d) rounds; nodes whose pointers have left the root
take no further part.

Texts are read once and never shuffled. Turns of one conversation, of which it may have any number, are numbered and
summed in stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, split_join

#: Most turns that are taken from the first conversation of a hundred.
HEAD = 5
#: Turns of a conversation that one window orders.
STRETCH = 4096
WORDS = [f"w{i}" for i in range(4)]


def numbered(turns: DataFrame, by: str, order: list[str], kept: Scratch) -> DataFrame:
    """``turns`` with ``place``: from 0 in the order of ``order`` within ``by``, equal rows in any order.

    Rows are dealt out by range, so that a key of very many rows is numbered in many tasks; what comes before a task's
    first row of a key is known from counts of the keys that cross tasks, two a task at most.
    """
    ranged = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(by, *order, "tie")
    ranged = kept.keep(ranged.withColumn("task", F.spark_partition_id()))
    counts = kept.keep(ranged.groupBy(by, "task").agg(F.count("*").alias("n")))
    crossing = counts.groupBy(by).agg(F.count("*").alias("tasks")).where("tasks > 1").select(by)
    before = Window.partitionBy(by).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(F.broadcast(crossing), by).select(by, "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(by, "task").orderBy(*order, "tie")
    rank = ranged.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(starts), [by, "task"], "left")
    return rank.withColumn("place", F.col("rank") + F.coalesce("start", F.lit(0))).drop("rank", "start", "task", "tie")


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    # the role's length parts it from the text
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"),
        F.length(text).cast("bigint").alias("chars"),
    )


def rebuilt(turns: DataFrame, kept: Scratch, group: int = 100) -> DataFrame:
    """(conv, depth, digest, chars, ends): the turns of each rebuilt conversation from depth 1, and its depth 0.

    A conversation takes its first h turns, h below six by the checksum of its number, from the first conversation of its
    hundred, as far as that has them, and goes on with its own from the h-th.
    """
    placed = kept.keep(numbered(turns, "conv", ["turn", "digest"], kept))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEAD + 1))
    base = F.col("conv") - F.col("conv") % group
    own = placed.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", h.alias("h"), base.alias("base"))
    own = kept.keep(own)
    first = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    lengths = own.join(first, "base", "left").withColumn("from_base", F.least("h", F.coalesce("base_n", F.lit(0))))
    depth = F.col("from_base") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    lengths = kept.keep(lengths.select("conv", "n", "h", "base", "from_base", depth.alias("length")))
    tail = split_join(placed, lengths, "conv", "n").where("place >= h")
    tail = tail.select("conv", (F.col("place") - F.col("h") + F.col("from_base") + 1).alias("depth"), "digest", "chars", "length")
    head = placed.where((F.col("conv") % group == 0) & (F.col("place") < HEAD)).select(F.col("conv").alias("base"), "place", "digest", "chars")
    head = lengths.join(head, "base").where("place < h").select("conv", (F.col("place") + 1).alias("depth"), "digest", "chars", "length")
    root = lengths.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("bigint").alias("chars"), "length")
    every = tail.unionByName(head).unionByName(root)
    return every.select("conv", F.col("depth").cast("bigint").alias("depth"), "digest", "chars", (F.col("depth") == F.col("length")).alias("ends"))


def _key(depth: Column, sums: list[Column]) -> Column:
    """128 bits that name a prefix."""
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


def prefixes(turns: DataFrame, kept: Scratch) -> DataFrame:
    """``turns`` (conv, depth, digest, ...) with ``node`` and ``parent``, keys of the prefixes of depth and depth - 1.

    Words are 32 bits of a digest of depth and turn, so that sums of 2^31 of them fit; equal sums of all four by chance are
    as rare as equal digests of 128 bits.
    """
    turn = F.sha2(F.concat_ws(",", F.col("depth").cast("string"), "digest").cast("binary"), 256)
    words = [F.when(F.col("depth") > 0, F.conv(F.substring("turn", 8 * i + 1, 8), 16, 10).cast("bigint")).otherwise(0).alias(w) for i, w in enumerate(WORDS)]
    stretch = F.floor(F.col("depth") / STRETCH).alias("stretch")
    rows = kept.keep(turns.withColumn("turn", turn).select(*[c for c in turns.columns if c != "digest"], stretch, *words))
    totals = rows.groupBy("conv", "stretch").agg(*[F.sum(w).alias(f"t{w}") for w in WORDS])
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    long = rows.where("stretch > 0").select("conv").distinct()
    starts = totals.join(long, "conv", "left_semi").select("conv", "stretch", *[F.coalesce(F.sum(f"t{w}").over(before), F.lit(0)).alias(f"s{w}") for w in WORDS])
    upto = Window.partitionBy("conv", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("*", *[F.sum(w).over(upto).alias(f"u{w}") for w in WORDS]).join(starts, ["conv", "stretch"], "left")
    at = [F.col(f"u{w}") + F.coalesce(F.col(f"s{w}"), F.lit(0)) for w in WORDS]
    above = [a - F.col(w) for a, w in zip(at, WORDS)]
    parent = F.when(F.col("depth") > 0, _key(F.col("depth") - 1, above))
    return sums.select("conv", "depth", "chars", "ends", _key(F.col("depth"), at).alias("node"), parent.alias("parent"))


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (node, conv) to (node, ends_sha256), a digest at a time: a list is never held whole."""
    node, digest = None, None

    def done(names: list, hexes: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hexes, pa.string())], names=["node", "ends_sha256"])

    for b in batches:
        if not b.num_rows:
            continue
        nodes, texts = b.column("node").to_pylist(), pc.cast(b.column("conv"), pa.string()).to_pylist()
        names, hexes, i = [], [], 0
        while i < len(nodes):
            j = i + 1
            while j < len(nodes) and nodes[j] == nodes[i]:
                j += 1
            part = ",".join(texts[i:j]).encode()
            if nodes[i] == node:
                digest.update(b"," + part)
            else:
                if digest:
                    names.append(node)
                    hexes.append(digest.hexdigest())
                node, digest = nodes[i], hashlib.sha256(part)
            i = j
        yield done(names, hexes)
    if digest:
        yield done([node], [digest.hexdigest()])


def rolled_up(nodes: DataFrame, kept: Scratch) -> DataFrame:
    """(node, n_leaves, saved_tokens) over whole subtrees, from written ``nodes`` (node, parent, leaves, saved).

    In round k a node's sums are those of its descendants nearer than 2^k, and its pointer is its ancestor 2^k above. What a
    node receives is summed before it is shuffled; pointers to busy ancestors are looked up by broadcast.
    """
    active = nodes.where("parent is not null").select("node", F.col("parent").alias("up"), "leaves", "saved")
    parts = [nodes.select("node", "leaves", "saved")]
    while not active.isEmpty():
        got = active.groupBy("up").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("senders"))
        got = kept.keep(got.select(F.col("up").alias("node"), "leaves", "saved", "senders"))
        parts.append(got.drop("senders"))
        # pointers to ancestors that have none themselves end here
        ancestors = active.select("node", "up").join(got.select("node", "senders"), "node")
        ancestors = kept.keep(ancestors.select(F.col("node").alias("up"), F.col("up").alias("next"), "senders"))
        more = got.select("node", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
        sums = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        held = active.join(more, "node", "left").select("node", "up", *sums)
        active = kept.keep(split_join(held, ancestors, "up", "senders").select("node", F.col("next").alias("up"), "leaves", "saved"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row for each node.

    A conversation is rebuilt with turns of the first one of its hundred (``rebuilt``). conv_id is the node's smallest
    member, which with depth names it. n_leaves and saved_tokens are sums over the subtree, its top included.

    Turns are ordered by ``turn``, nulls first; turns of one number by the digest of role and text, a fixed order whatever
    the partitions. A row that is there twice is two turns. A null role or text is empty. Rows without a conversation's id
    belong to none and are left out. Other columns play no part. An empty table has no node, not even the root.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    with Scratch(conversations.sparkSession) as kept:
        rows = kept.keep(prefixes(rebuilt(turns, kept), kept))
        # a node's key gives its parent, depth and last turn
        nodes = kept.keep(rows.groupBy("node", "parent", "depth", "chars").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")))
        children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
        saved = (F.col("n_convs") - 1) * F.col("chars")
        nodes = nodes.join(children, "node", "left").select(
            "node", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.col("n_children").isNull().cast("bigint").alias("leaves"), saved.alias("saved"),
        )
        nodes = kept.keep(nodes)
        sums = rolled_up(nodes, kept)
        ends = rows.where("ends").select("node", "conv").repartition("node").sortWithinPartitions("node", "conv")
        ends = ends.mapInArrow(_hash_lists, "node binary, ends_sha256 string")
        named = nodes.join(sums, "node").join(ends, "node", "left")
        above = nodes.where("n_children > 0").select(
            F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings")
        )
        below = split_join(named.where("parent is not null"), kept.keep(above), "parent", "siblings").drop("siblings")
        root = named.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
        empty = F.lit(hashlib.sha256(b"").hexdigest())
        out = below.unionByName(root).select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", empty).alias("ends_sha256"),
        )
        return cut(out)
