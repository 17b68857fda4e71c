"""Ordered suppression: rows stay unless a better one that stays has a text that is alike.

Texts of an identity meet only under runs of two characters that those alike must share: of a text the rarest runs are its
keys, as many as edits can destroy and one more. Pairs that pass are compared once; then rounds decide rows all of whose
better neighbours are decided, which gives what going through the rows in order gives.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, ratio
from ..sources.scratch import Scratch, checkpointed

RUN = 2


def runs(text: str) -> list[str]:
    """The text's runs of two characters, those that come again with the number of their place, so that all differ."""
    seen: Counter[str] = Counter()
    out = []
    for i in range(len(text) - RUN + 1):
        g = text[i : i + RUN]
        seen[g] += 1
        out.append(g if seen[g] == 1 else f"{g}{seen[g]}")
    return out


def keys_needed(length: int, least: float) -> int:
    """How many of a text's rarest runs one at least of which every text alike has, too.

    A ratio of least / 100 = r leaves (1 - r) (n + m) characters to drop or put in, of which m is at most n (2 - r) / r; each is in
    two of the runs at most.
    """
    r = least / 100
    return int(RUN * (1 - r) * length * 2 / r + 1e-9) + 1


def _normal(heads: DataFrame, text: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in heads.schema if f.name != text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            normal = [normalize_text(t) for t in pdf.pop(text)]
            yield pdf.assign(__t=normal, __runs=[runs(t) for t in normal])

    return heads.mapInPandas(run, f"{schema}, __t string, __runs array<string>")


def alike(heads: DataFrame, identity: list[str], least: float, kept: Scratch) -> DataFrame:
    """(a, b): ranks of pairs of an identity whose texts are alike, a the better one. ``heads`` has rank, identity, __t and
    __runs; texts differ, or are short and then alike only if they are equal."""
    run = heads.select(*identity, "rank", F.length("__t").alias("n"), F.explode("__runs").alias("run"))
    often = run.groupBy(*identity, "run").agg(F.count("*").alias("often")).where("often > 1")
    # runs that no other text has are no keys, but count among the rarest
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in identity]
    ranked = run.alias("r").join(often.alias("o"), [*same, F.col("r.run") == F.col("o.run")], "left").select("r.*", F.coalesce("often", F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("rank").orderBy("often", "run"))
    r = least / 100
    needed = F.floor(F.col("n") * (RUN * (1 - r) * 2 / r) + 1e-9) + 1
    keys = kept.keep(ranked.withColumn("place", place).where((F.col("place") <= needed) & (F.col("often") > 1)).select(*identity, "run", "rank", "n"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in identity]
    fits = 200.0 * F.least("l.n", "r.n") >= least * (F.col("l.n") + F.col("r.n"))
    pairs = keys.alias("l").join(keys.alias("r"), [*on, F.col("l.run") == F.col("r.run"), F.col("l.rank") < F.col("r.rank"), fits])
    pairs = pairs.select(F.col("l.rank").alias("a"), F.col("r.rank").alias("b")).distinct()
    # texts without two runs to share are alike if they are equal in normal form
    equal = heads.alias("l").join(heads.alias("r"), [*on, F.col("l.__t") == F.col("r.__t"), F.col("l.rank") < F.col("r.rank"), F.length("l.__t") < 4])
    text = heads.select(F.col("rank"), "__t")
    both = pairs.join(text.toDF("a", "s"), "a").join(text.toDF("b", "t"), "b")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.loc[[ratio(s, t) >= least for s, t in zip(pdf["s"], pdf["t"])], ["a", "b"]]

    compared = both.select("a", "b", "s", "t").mapInPandas(compare, "a bigint, b bigint")
    return compared.unionByName(equal.select(F.col("l.rank").alias("a"), F.col("r.rank").alias("b"))).distinct()


def decided(ranks: DataFrame, edges: DataFrame, kept: Scratch) -> DataFrame:
    """(rank, by): of each row the best neighbour before it that stays, or itself if there is none.

    A round keeps all open rows without an open better neighbour and drops those next to them. Its number is that of rows in a
    row, each of which the one before would drop.
    """
    edges = kept.keep(edges)
    stays, left = [], edges
    closed = None
    while True:
        waiting = left.select(F.col("b").alias("rank")).distinct()
        first = kept.keep(left.select(F.col("a").alias("rank")).distinct().join(waiting, "rank", "left_anti"))
        if first.isEmpty():
            break
        stays.append(first)
        gone = left.join(first, F.col("a") == F.col("rank"), "left_semi").select(F.col("b").alias("rank")).distinct()
        out = kept.keep(gone.unionByName(first))
        closed = out if closed is None else closed.unionByName(out)
        # an edge is over when either end is decided
        left = left.join(out, F.col("a") == F.col("rank"), "left_anti").join(out, F.col("b") == F.col("rank"), "left_anti")
        left = kept.keep(left)
    if not stays:
        return ranks.select("rank", F.col("rank").alias("by"))
    keeps = stays[0]
    for s in stays[1:]:
        keeps = keeps.unionByName(s)
    # rows whose better neighbours were all dropped by others stay, though no round named them
    named = edges.select(F.explode(F.array("a", "b")).alias("rank")).distinct()
    free = named.join(closed.distinct(), "rank", "left_anti")
    keeps = kept.keep(keeps.unionByName(free).distinct())
    by = edges.join(keeps, F.col("a") == F.col("rank"), "left_semi").groupBy(F.col("b").alias("rank")).agg(F.min("a").alias("by"))
    by = by.join(keeps, "rank", "left_anti")
    return ranks.select("rank").join(by, "rank", "left").select("rank", F.coalesce("by", "rank").alias("by"))


def fuzzy_dedupe(df: DataFrame, identity: list[str], key: str, text: str, confidence: str, least: float = 90.0) -> DataFrame:
    """(key, kept_by): rows in order of confidence, ties by key; a row goes if one kept of its identity has a text that is alike.

    ``least`` is 90 or more, below which short texts may be alike without a run in common. ``kept_by`` is the row that stands for
    it, itself if kept. Equal texts fold into one before texts are compared, so that
    copies, however many, cost nothing. Null texts are empty; empty texts equal each other.
    """
    if least < 90:
        raise ValueError("least must be 90 or more")
    same = [*identity, "__text"]
    rows = df.select(*identity, F.col(key).alias("__key"), F.coalesce(text, F.lit("")).alias("__text"), F.col(confidence).alias("__c"))
    with Scratch(df.sparkSession) as kept:
        order = F.struct((-F.col("__c").cast("double")).alias("c"), F.col("__key").alias("k"))
        heads = kept.keep(rows.groupBy(*same).agg(F.min(order).alias("o")))
        # places within an identity, as one number with that of the identity: ranks differ and go up by order
        groups = kept.keep(heads.select(*identity).distinct().withColumn("__g", F.monotonically_increasing_id()))
        of = [F.col(f"h.{c}").eqNullSafe(F.col(f"g.{c}")) for c in identity]
        heads = kept.keep(heads.alias("h").join(groups.alias("g"), of).select("h.*", "__g"))
        sequence = heads.repartitionByRange("__g", "o").sortWithinPartitions("__g", "o").withColumn("rank", F.monotonically_increasing_id())
        heads = kept.keep(sequence)
        ready = kept.keep(_normal(heads.select(*identity, "rank", "__text"), "__text"))
        told = decided(heads.select("rank"), alike(ready, identity, least, kept), kept)
        name = heads.select(F.col("rank").alias("by"), F.col("o.k").alias("kept_by"))
        told = kept.keep(heads.select(*same, "rank").join(told, "rank").join(name, "by").select(*same, "kept_by"))
        on = [rows[c].eqNullSafe(told[c]) for c in same]
        return checkpointed(rows.join(told, on).select(F.col("__key").alias(key), "kept_by"))
