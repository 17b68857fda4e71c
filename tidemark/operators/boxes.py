"""Merging boxes on pages, until none are left to merge: the boxes of a page, token and state meet in one row as lists of numbers
and are swept there; groups of very many boxes, and odd ones, by a self-join by band of lines, and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, checkpointed
from .joins import bounded

#: The share of the smaller box that makes an overlap, of the lower one's height that makes a line, and of the
#: taller one's height that may part neighbours.
OVERLAP, LINE, GAP = 0.5, 0.6, 0.6
#: Rows of equal bands of a page, each a join key; a box has those that it reaches with a neighbour's gap around it.
BANDS = 64
BOX = ("x", "y", "w", "h")
GROUP = ("doc_id", "page", "token", "enabled")
#: How many boxes of a group may meet in a row, and about how many of some groups are swept at once.
SMALL, AT_ONCE = 2_000, 100_000


def touches(a: str, b: str) -> Column:
    """Whether two boxes of one page, token and state are one."""
    c = lambda t, n: F.col(f"{t}.{n}")
    end = lambda t, at, size: c(t, at) + c(t, size)
    wide = F.least(end(a, "x", "w"), end(b, "x", "w")) - F.greatest(c(a, "x"), c(b, "x"))
    high = F.least(end(a, "y", "h"), end(b, "y", "h")) - F.greatest(c(a, "y"), c(b, "y"))
    area = lambda t: F.greatest(c(t, "w"), F.lit(0.0)) * F.greatest(c(t, "h"), F.lit(0.0))
    shared = F.when((wide > 0) & (high > 0), wide * high).otherwise(0.0) / F.greatest(F.least(area(a), area(b)), F.lit(1e-9))
    line = (high >= LINE * F.least(c(a, "h"), c(b, "h"))) & (-wide < GAP * F.greatest(c(a, "h"), c(b, "h")))
    return (shared >= OVERLAP) | (c(a, "token").isNotNull() & line)


def _pairs(boxes: DataFrame) -> DataFrame:
    """(a, b), a < b: numbers of boxes that are one."""
    band = lambda y: F.least(F.greatest(F.floor(y * BANDS), F.lit(0)), F.lit(BANDS - 1)).cast("int")
    rows = boxes.withColumn("band", F.explode(F.sequence(band(F.col("y")), band(F.col("y") + F.greatest("h", F.lit(0.0))))))
    on = (
        (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col("l.page") == F.col("r.page")) & (F.col("l.band") == F.col("r.band"))
        & (F.col("l.enabled") == F.col("r.enabled")) & F.col("l.token").eqNullSafe(F.col("r.token")) & (F.col("l.box") < F.col("r.box"))
    )
    return rows.alias("l").join(rows.alias("r"), on & touches("l", "r")).select(F.col("l.box").alias("a"), F.col("r.box").alias("b")).distinct()


def _components(pairs: DataFrame, kept: Scratch) -> DataFrame:
    """(box, root): the smallest number reachable; labels fall to a neighbour's, then to their label's, until they stay."""
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = kept.keep(edges.groupBy(F.col("a").alias("box")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = edges.join(label, F.col("b") == F.col("box")).groupBy(F.col("a").alias("box")).agg(F.min("root").alias("near"))
        low = label.join(near, "box").select("box", F.least("root", "near").alias("root"))
        jump = low.select(F.col("box").alias("root"), F.col("root").alias("next"))
        new = kept.keep(low.join(jump, "root").select("box", F.col("next").alias("root")))
        if new.alias("n").join(label.alias("o"), "box").where("n.root <> o.root").isEmpty():
            return new
        label = new


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` the smallest number that pairs lead to."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _touching(of: np.ndarray, named: np.ndarray, box: dict[str, np.ndarray], most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of boxes of one group that are one (``touches``): each box with those that begin between its top and its end."""
    n = len(of)
    order = np.lexsort((box["y"], of))
    # where a box's end falls among the beginnings of its group
    ends = np.concatenate([box["y"], box["y"] + box["h"]])[(both := np.concatenate([order, order + n]))]
    mixed = np.lexsort((both >= n, ends, np.concatenate([of[order], of[order]])))
    before = np.empty(2 * n, np.int64)
    before[mixed] = np.cumsum(mixed < n)
    many = np.maximum(before[n:] - np.arange(n) - 1, 0)
    total, found, at = np.concatenate([[0], np.cumsum(many)]), ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)]), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        first = np.repeat(np.arange(at, to), many[at:to])
        second = first + 1 + np.arange(len(first)) - (total[first] - total[at])
        a, b, at = order[first], order[second], to
        x, y, w, h = (box[c] for c in BOX)
        wide = np.minimum(x[a] + w[a], x[b] + w[b]) - np.maximum(x[a], x[b])
        high = np.minimum(y[a] + h[a], y[b] + h[b]) - np.maximum(y[a], y[b])
        shared = np.where((wide > 0) & (high > 0), wide * high, 0.0) / np.maximum(np.minimum(w[a] * h[a], w[b] * h[b]), 1e-9)
        line = (high >= LINE * np.minimum(h[a], h[b])) & (-wide < GAP * np.maximum(h[a], h[b]))
        one = (shared >= OVERLAP) | (named[of[a]] & line)
        found[0].append(a[one])
        found[1].append(b[one])
    return np.concatenate(found[0]), np.concatenate(found[1])


def _merged(of: np.ndarray, named: np.ndarray, box: dict[str, np.ndarray], source: np.ndarray, confidence: np.ndarray) -> tuple:
    """(group, box, source, confidence, members) of boxes merged until no two of a group are one."""
    members = np.ones(len(of), np.int64)
    while True:
        a, b = _touching(of, named, box)
        if not len(a):
            return of, box, source, confidence, members
        to = _roots(len(of), a, b)
        order = np.argsort(to, kind="stable")
        at = np.flatnonzero(np.diff(to[order], prepend=-1))
        low, high = (lambda v, f=f: f.reduceat(v[order], at) for f in (np.minimum, np.maximum))
        alone, first = np.diff(at, append=len(order)) == 1, order[at]
        x, y = low(box["x"]), low(box["y"])
        w = np.where(alone, box["w"][first], high(box["x"] + box["w"]) - x)
        h = np.where(alone, box["h"][first], high(box["y"] + box["h"]) - y)
        of, source, confidence, members = of[first], low(source), high(confidence), np.add.reduceat(members[order], at)
        box = {"x": x, "y": y, "w": w, "h": h}


def _in_tasks(rows: DataFrame, schema: str) -> DataFrame:
    """``merge_boxes`` of groups of which each fits in a row."""
    lists = [F.collect_list(c).alias(c) for c in BOX] + [F.collect_list(F.struct(c)).alias(c) for c in ("source", "confidence")]
    grouped = rows.groupBy(*GROUP).agg(*lists)  # none of the coordinates is null, so that the lists go together

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("x")).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(ends):  # some groups at a time
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
                b, at = batch.slice(at, to - at), to
                of = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("x")).to_numpy(zero_copy_only=False))
                box = {c: b.column(c).flatten().to_numpy(zero_copy_only=False) for c in BOX}
                source = b.column("source").flatten().field(0)
                texts = sorted(x for x in pc.unique(source).to_pylist() if x is not None)
                rank = pc.fill_null(pc.index_in(source, pa.array(texts, pa.string())), len(texts)).to_numpy(zero_copy_only=False)
                sure = pc.fill_null(b.column("confidence").flatten().field(0), -np.inf).to_numpy(zero_copy_only=False)
                named = b.column("token").is_valid().to_numpy(zero_copy_only=False)
                of, box, rank, sure, members = _merged(of, named, box, rank, sure)
                keys = [b.column(c).take(pa.array(of)) for c in GROUP]
                told = pa.array([*texts, None], pa.string()).take(pa.array(rank))
                yield pa.RecordBatch.from_arrays(
                    [*keys, told, *[pa.array(box[c]) for c in BOX], pa.array(sure, mask=sure == -np.inf), pa.array(members)],
                    names=[*GROUP, "source", *BOX, "confidence", "members"],
                )

    return grouped.mapInArrow(run, schema)


def _by_joins(rows: DataFrame) -> DataFrame:
    """``merge_boxes`` of groups of any size."""
    with Scratch(rows.sparkSession) as kept:
        now = kept.keep(rows.withColumn("box", F.monotonically_increasing_id()))
        columns = now.columns
        while True:
            pairs = kept.keep(_pairs(now))
            if pairs.isEmpty():
                return checkpointed(now.drop("box"))
            root = F.coalesce("root", "box").alias("to")
            labelled = now.join(_components(pairs, kept), "box", "left").select("*", root).drop("root", "box")
            right, low, alone = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h")), F.count("*") == 1
            now = labelled.groupBy(*GROUP, F.col("to").alias("box")).agg(
                F.min("source").alias("source"), F.min("x").alias("x"), F.min("y").alias("y"), F.when(alone, F.min("w")).otherwise(right - F.min("x")).alias("w"),
                F.when(alone, F.min("h")).otherwise(low - F.min("y")).alias("h"), F.max("confidence").alias("confidence"), F.sum("members").alias("members"),
            )
            now = kept.keep(now.select(*columns))


def merge_boxes(boxes: DataFrame, small: int = SMALL) -> DataFrame:
    """(doc_id, page, token, enabled, source, x, y, w, h, confidence, members): boxes merged until no two are one.

    Boxes of one page, token and state are one if they share half of the smaller one, or, with a token, if they are
    neighbours on a line; those drawn by hand stay as they are. A merged box is the bounding box of its members with the
    greatest confidence. All that touch merge in a round, and what that makes touch in the next. Coordinates are
    shares of the page. Boxes without a token merge by overlap alone. Nulls in coordinates, document, page or state: such boxes touch nothing.

    Groups of up to ``small`` boxes are swept in their tasks, after one shuffle; larger ones, and those with sizes below zero or
    coordinates that are no numbers, meet by joins, with the same result.
    """
    rows = boxes.select(*GROUP, "source", *[F.col(c).cast("double").alias(c) for c in BOX], F.col("confidence").cast("double").alias("confidence"), F.lit(1).cast("bigint").alias("members"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = F.lit(True)
    for c in ("doc_id", "page", "enabled", *BOX):
        placed = placed & F.col(c).isNotNull()
    stays = (F.coalesce("source", F.lit("")) == "manual") | ~placed
    now = rows.where(~stays)
    odd = (F.least("w", "h") < 0) | F.isnan("x") | F.isnan("y") | F.isnan("w") | F.isnan("h")
    large = now.groupBy(*GROUP).agg(F.count("*").alias("n"), F.bool_or(odd).alias("odd")).where((F.col("n") > small) | F.col("odd"))
    large = checkpointed(large.select(*[F.col(c).alias(f"of_{c}") for c in GROUP]))
    if large.isEmpty():
        return rows.where(stays).unionByName(_in_tasks(now, schema))
    its = lambda: [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in GROUP]
    few, many = (now.join(bounded(large), its(), how) for how in ("left_anti", "left_semi"))
    return rows.where(stays).unionByName(_in_tasks(few, schema)).unionByName(_by_joins(many))
