"""Guards over event streams: sliding rate limits, distinct caps, daily spend, metric bins; batch and streaming."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.conversation import MessageFold, canonical_json


def waits(times: Iterable[float], let_in: list[float], most: int, seconds: float) -> list[int | None]:
    """For each time, in order, None if it is let in, else whole seconds to wait.

    A time is let in if the one that was let in ``most`` times before it lies outside the window; refused ones take no
    place. ``let_in`` holds earlier ones and is added to; only its last ``most`` matter.
    """
    out: list[int | None] = []
    for t in times:
        left = let_in[-most] + seconds - t if len(let_in) >= most else 0.0
        out.append(math.ceil(left) if left > 0 else None)
        if left <= 0:
            let_in.append(t)
    return out


def _seconds(ts: pd.Series) -> list[float]:
    return (ts.astype("int64") / 1e9).tolist() if str(ts.dtype) == "datetime64[ns]" else [t.timestamp() for t in ts]


def rate_limit(df: DataFrame, key: str, ts: str, tie: str, most: int, seconds: float) -> DataFrame:
    """(tie, key, allowed, retry_after): each key's events in order of time against a sliding window.

    After a pause as long as the window nothing before matters, so that a key's events fall apart there; Python holds
    256 such stretches at a time. The window function and the groups share one shuffle by key.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, tie])
        wait = waits(_seconds(pdf[ts]), [], most, seconds)
        return pd.DataFrame({tie: pdf[tie], key: pdf[key], "allowed": [w is None for w in wait], "retry_after": pd.array(wait, "Int64")})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (tie, key)}
    w = Window.partitionBy(key).orderBy(ts, tie)
    pause = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    soon = F.lag(ts).over(w) + pause > F.col(ts)
    rows = df.select(key, ts, tie).withColumn("__new", F.when(soon, 0).otherwise(1))
    rows = rows.withColumn("__run", F.floor(F.sum("__new").over(w) / 256)).drop("__new")
    return rows.groupBy(key, "__run").applyInPandas(run, f"{tie} {kinds[tie]}, {key} {kinds[key]}, allowed boolean, retry_after bigint")


def rate_limit_stream(df: DataFrame, key: str, ts: str, tie: str, most: int, seconds: int) -> DataFrame:
    """The same over a stream: state is the times let in, dropped once a key has been idle for a window.

    Rows of a batch are taken in order of time; rows older than an earlier batch's count at their own time.
    """

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        let_in = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values([ts, tie])
        wait = waits(_seconds(pdf[ts]), let_in, most, seconds)
        state.update((let_in[-most:],))
        state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({tie: pdf[tie], key: keys[0], "allowed": [w is None for w in wait], "retry_after": pd.array(wait, "Int64")})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (tie, key)}
    return df.select(key, ts, tie).groupBy(key).applyInPandasWithState(
        run, f"{tie} {kinds[tie]}, {key} {kinds[key]}, allowed boolean, retry_after bigint", "hits array<double>", "append", "ProcessingTimeTimeout"
    )


def pages_fit(uploads: Iterable[list[int]], most: int) -> list[bool]:
    """Of one document's uploads of a day, in order, which fit: no page above ``most``, no more than that distinct ones
    with those of uploads that fitted before, and no more than twice as many pages in all."""
    seen, total, out = 0, 0, []
    for pages in uploads:
        low = max(pages, default=0) <= most
        own = sum(1 << p for p in set(pages)) if low else 0  # a set of pages as bits
        fits = low and (seen | own).bit_count() <= most and total + len(pages) <= 2 * most
        if fits:
            seen, total = seen | own, total + len(pages)
        out.append(fits)
    return out


def page_caps(df: DataFrame, most_documents: int = 3, most_pages: int = 120) -> DataFrame:
    """(ip, day, seq, verdict): uploads (ip, day, seq, document, pages array) against caps of the day, in order of seq.

    ``page_cap``: the pages don't fit (``pages_fit``); a document's pages count over all addresses. ``booklet_cap``: the
    pages fit, and count, but the address has had ``most_documents`` others that fitted before. Else ``ok``. The second rule
    needs no fold: an address may send those documents whose first fitting uploads were its first.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("ip", "day", "seq", "document")}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        fits = pages_fit(([int(p) for p in pages] for pages in pdf["pages"]), most_pages)
        return pdf[["ip", "day", "seq", "document"]].assign(fits=fits)

    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", fits boolean"
    judged = df.select("ip", "day", "seq", "document", "pages").groupBy("day", "document").applyInPandas(run, schema)
    first = F.min(F.when(F.col("fits"), F.col("seq"))).over(Window.partitionBy("ip", "day", "document"))
    place = F.dense_rank().over(Window.partitionBy("ip", "day").orderBy(F.col("__first").asc_nulls_last()))
    ranked = judged.withColumn("__first", first).withColumn("__place", place)
    verdict = F.when(~F.col("fits"), "page_cap").when(F.col("__place") > most_documents, "booklet_cap").otherwise("ok")
    return ranked.select("ip", "day", "seq", verdict.alias("verdict"))


def bins_stream(df: DataFrame, grain: str, late: str, keys: list[str], value: Column) -> DataFrame:
    """Tumbling sums and counts; rows later than ``late`` are left out, and a bin is given when it can't change."""
    per = df.withWatermark("ts", late).groupBy(*keys, F.window("ts", grain).alias("w"))
    return per.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*keys, F.col("w.start").alias("bin"), "n", "total")


def daily_spend_stream(df: DataFrame, key: str, cents: Column, late: str = "1 hour") -> DataFrame:
    """(key, day, spent) of UTC days, updated as rows arrive."""
    per = df.withWatermark("ts", late).groupBy(key, F.window("ts", "1 day").alias("w")).agg(F.sum(cents).alias("spent"))
    return per.select(key, F.to_date("w.start").alias("day"), "spent")


def fold_stream(df: DataFrame) -> DataFrame:
    """(message_id, json) after each batch, from (message_id, seq, event): the message so far is the state."""

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fold = MessageFold(json.loads(state.get[0]) if state.exists else None)
        for e in pd.concat(list(frames)).sort_values("seq")["event"]:
            fold.feed(json.loads(e))
        if fold.message["finish"]:
            if state.exists:
                state.remove()
        else:
            state.update((canonical_json(fold.state),))
        yield pd.DataFrame([(keys[0], canonical_json(fold.message))], columns=["message_id", "json"])

    return df.groupBy("message_id").applyInPandasWithState(run, "message_id bigint, json string", "json string", "update", "NoTimeout")


def capped_bytes(df: DataFrame, key: str, order: str, size: str, cap: int) -> DataFrame:
    """Adds ``over``: whether a request's bytes, up to this part, are above the cap."""
    run = F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("over", run > cap)
