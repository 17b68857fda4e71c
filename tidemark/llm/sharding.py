"""Sharding by fixed virtual slots, on DataFrame functions alone.

Rows hash into ``slots`` virtual slots; bytes are summed per slot; a slot map (version, virtual_slot, shard) names
each slot's shard. The first version deals slots out in turn, whatever they hold; ``rebalance`` edits a stored map into
the next version, moving only what overfull shards have too much. Maps have ``slots`` rows whatever the input, so that
they may be broadcast. Every version is stored beside the others, and writing one again changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, keyed_texts, remove, shared_dir

SLOTS = 4096


def virtual_slot(id_col: Column, text: Column, slots: int = SLOTS) -> Column:
    """Slot of a row by its id; rows without an id go by their text."""
    digest = F.md5(F.coalesce(id_col.cast("string"), text, F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) for each row; a null text has size 1 and the checksum of no bytes.

    Rows of one id share a slot, unless they hold more bytes than a slot does on average: then they are parts, as many
    as keep each below that, among which its rows are dealt in turn. So no id makes a slot, or a task, overfull.
    """
    df = keyed_texts(docs, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    rows = cut(
        df.select(
            "doc_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), "text")).alias("name"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), virtual_slot(F.col("doc_id"), F.col("text"), slots).alias("whole"),
            F.monotonically_increasing_id().alias("number"),
        )
    )
    total = rows.agg(F.sum("size").alias("t")).scalar()
    parts = F.ceil(F.col("bytes") * slots / total).cast("int")
    held = rows.groupBy("name").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # fewer than slots names can hold more than the mean of a slot
    hot = cut(held.where((F.col("n") > 1) & (F.col("bytes") * slots > total)).select(F.col("name").alias("hot"), parts.alias("parts")))
    rows = rows.join(F.broadcast(hot), F.col("name") == F.col("hot"), "left")
    spread = F.pmod(F.xxhash64("name", F.pmod("number", "parts")), F.lit(slots)).cast("int")
    slot = F.when(F.col("parts").isNull(), F.col("whole")).otherwise(spread)
    return rows.select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, n) for all slots, empty ones included."""
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    got = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return every.join(F.broadcast(got), "virtual_slot", "left").fillna(0, ["bytes", "n"])


def _dealt(loads: Column, first: Column, shards: int) -> Column:
    """Array of (virtual_slot, shard), from an array of (bytes, virtual_slot) taken in its order."""
    start = F.struct(first.alias("load"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        to = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        load = F.transform(acc["load"], lambda v, i: F.when(i == to, v + x["bytes"]).otherwise(v))
        row = F.struct(x["virtual_slot"].alias("virtual_slot"), to.alias("shard"))
        return F.struct(load.alias("load"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(loads, start, step)["out"]


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """(version, virtual_slot, shard) of version 1: slots in turn, before anything is known of them."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(1).alias("version"), slot.alias("virtual_slot"), F.pmod(slot, F.lit(shards)).alias("shard"))


def skewed(slot_map: DataFrame, totals: DataFrame, shards: int, tolerance: float) -> bool:
    """Whether a shard of one version of a map is further than ``tolerance`` times the mean from the mean of bytes, or
    the map names a shard that there isn't."""
    load = slot_map.join(F.broadcast(totals), "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b"))
    every = slot_map.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    load = every.join(F.broadcast(load), "shard", "full").fillna(0, ["b"])
    mean = F.sum("b") / shards
    off = F.greatest(F.max("b") - mean, mean - F.min("b")) > tolerance * mean
    return load.agg((off | (F.max("shard") >= shards)).alias("off")).first().off


def rebalance(old: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, for new slot totals and maybe another number of shards.

    A shard keeps its slots, largest first, as long as they fit in the mean; the small ones left, and all those of
    shards that exist no longer, are dealt to the lightest shards. The result holds the new version alone.
    """
    version = old.agg((F.max("version") + 1).alias("next"))
    last = old.join(F.broadcast(old.agg(F.max("version").alias("version"))), "version").drop("version")
    mean = totals.agg((F.sum("bytes") / shards).alias("mean"))
    w = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    rows = last.join(F.broadcast(totals), "virtual_slot").withColumn("run", F.sum("bytes").over(w))
    rows = rows.join(F.broadcast(mean)).withColumn("stays", (F.col("shard") < shards) & (F.col("run") <= F.col("mean")))
    stay = rows.where("stays")
    per = stay.groupBy("shard").agg(F.sum("bytes").alias("b"))
    every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = every.join(F.broadcast(per), "shard", "left").fillna(0).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("shard", "b"))), lambda x: x["b"]).alias("l")
    )
    moved = rows.where("not stays").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes"))).alias("s")
    )
    dealt = moved.join(F.broadcast(loads)).select(F.inline(_dealt(F.col("s"), F.col("l"), shards)))
    both = stay.select("virtual_slot", "shard").unionByName(dealt)
    return both.join(F.broadcast(version)).select(F.col("next").alias("version"), "virtual_slot", "shard")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Write versions to the stored map at ``path``, partitioned by version; one that is there already is replaced, so
    that a write that was tried twice leaves it once."""
    out = slot_map.select("virtual_slot", "shard", "version").coalesce(1).write.mode("overwrite")
    out.option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All versions stored at ``path``, or one."""
    df = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    return df if version is None else df.where(F.col("version") == version)


def last_version(spark: SparkSession, path: str) -> int | None:
    """The latest version stored at ``path``; None if there is no map."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return load_map(spark, path).agg(F.max("version")).first()[0]


def shard(
    docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None, tolerance: float = 0.001,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, version): one row for each row of ``docs``.

    Law ``bytes``. The map is the last one stored at ``path`` (default: a folder of its own in the shared folder, for
    this call); without one, version 1 is stored. If that leaves a shard further than ``tolerance`` from the mean of
    bytes, it is edited into the next version, which is stored too. ``version`` is the one used. ``slot`` is the row's
    place in its shard, gapless from 0: rows are numbered in their virtual slot by (doc_id, text_crc32, size), on from
    the rows of the shard's smaller virtual slots, so that no task orders a whole shard. Nulls: a null text counts 1
    byte, a row without an id is hashed by its text. Equal rows are interchangeable. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = path is None
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = cut(sized(docs, id_col, text_col, slots))
    totals = cut(slot_bytes(rows, slots))
    version = last_version(spark, path)
    if version is None:
        version = 1
        store_map(first_map(spark, shards, slots), path)
    dealt = cut(load_map(spark, path, version))
    if skewed(dealt, totals, shards, tolerance):
        store_map(rebalance(dealt, totals, shards), path)
        version += 1
        dealt = cut(load_map(spark, path, version))
    if own:
        remove(spark, path)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = dealt.join(F.broadcast(totals), "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from")
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(cut(places)), "virtual_slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("from") + F.col("rank")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(version).alias("version"),
    )
