"""Operations analytics over metric rows: bins, weighted percentiles, pivots, alerts, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import bounded


def bins(df: DataFrame, grain: str, keys: list[str], value: Column) -> DataFrame:
    """(keys, bin, n, total): counts and sums by tumbling window."""
    per = df.groupBy(*keys, F.window("ts", grain).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return per.select(*keys, F.col("w.start").alias("bin"), "n", "total")


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, share: float) -> DataFrame:
    """(keys, value): the least value up to which the weights make ``share`` of their sum.

    Weights are summed over 1,024 equal parts of a key's range first; only the part in which the share is reached is ordered
    by value, so that few keys with many values don't meet in few tasks.
    """
    x = F.col(value)
    ends = df.where(x.isNotNull()).groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.sum(weight).alias("__all"))
    part = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((x - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * 1024), F.lit(1023))).otherwise(0)
    per = df.where(x.isNotNull()).join(ends, keys).withColumn("__part", part).groupBy(*keys, "__part", value).agg(F.sum(weight).alias("__w"), F.first("__all").alias("__all"))
    parts = per.groupBy(*keys, "__part").agg(F.sum("__w").alias("__sum"), F.first("__all").alias("__need"))
    upto = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__part"))
    parts = parts.withColumn("__upto", upto).where(F.col("__upto") >= F.col("__need") * share)
    first = parts.groupBy(*keys).agg(F.min_by(F.struct("__part", (F.col("__upto") - F.col("__sum")).alias("before")), "__part").alias("__p"))
    inside = per.join(first, keys).where(F.col("__part") == F.col("__p.__part"))
    run = F.col("__p.before") + F.sum("__w").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("__run", run).where(F.col("__run") >= F.col("__all") * share).groupBy(*keys).agg(F.min(value).alias(value))


def pivot(df: DataFrame, key: Column, column: str, values: list[str], value: Column) -> DataFrame:
    """Sums of ``value``, a column for each of ``values``; 0 where there is none."""
    return df.groupBy(key).pivot(column, values).agg(F.sum(value)).fillna(0)


def error_alerts(df: DataFrame, grain: str, keys: list[str], bad: Column, least: int, rate: float) -> DataFrame:
    """(keys, bin, n, errors): bins with ``least`` rows or more of which over ``rate`` are bad."""
    per = df.groupBy(*keys, F.window("ts", grain).alias("w")).agg(F.count("*").alias("n"), F.count_if(bad).alias("errors"))
    return per.where((F.col("n") >= least) & (F.col("errors") > rate * F.col("n"))).select(*keys, F.col("w.start").alias("bin"), "n", "errors")


def spend_gate(df: DataFrame, key: str, cents: Column, limit: int) -> DataFrame:
    """Adds day, cents, spent (of the day so far, this row apart) and allowed (whether that is under the limit).

    Running sums are made in two steps, over minutes and within each, so that a busy key's day is not one task's.
    """
    zero = F.lit(0).cast("bigint")
    rows = df.withColumns({"day": F.to_date("ts"), "cents": cents, "__m": F.date_trunc("minute", "ts")})
    per = rows.groupBy(key, "day", "__m").agg(F.sum("cents").alias("__sum"))
    earlier = Window.partitionBy(key, "day").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), zero)).drop("__sum", "day")
    within = Window.partitionBy(key, "__m").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__own", F.coalesce(F.sum("cents").over(within), zero)).join(per, [key, "__m"])
    spent = F.col("__before") + F.col("__own")
    return out.withColumn("spent", spent).withColumn("allowed", F.col("spent") < limit).drop("__before", "__own", "__m")


#: List prices in dollars, per million tokens in and out, and per thousand pages, fields' pages and records;
#: the model whose price unknown ones have.
PRICES = {"gpt-5-mini": (0.25, 2.00), "gpt-5-nano": (0.05, 0.40), "text-embedding-3-small": (0.02, 0.0)}
CHAT_MODEL = "gpt-5-mini"
PAGE, FIELD_PAGE, LANGUAGE_RECORD, SAFETY_RECORD = 5.0, 5.0, 1.0, 0.75


def token_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Micro-dollars of a model's tokens, as a decimal."""
    exact = lambda x: F.lit(str(x)).cast("decimal(10,4)")
    price = lambda pair: tokens_in * exact(pair[0]) + tokens_out * exact(pair[1])
    return F.coalesce(*[F.when(model == m, price(p)) for m, p in PRICES.items()], price(PRICES[CHAT_MODEL]))


def usage_cost(tokens: Column, pages: Column, field_pages: Column, language: Column, safety: Column) -> Column:
    """Dollars of a request, to six places: micro-dollars of its tokens, and its pages and records."""
    rate = lambda n, dollars: n * F.lit(str(dollars * 1000)).cast("decimal(10,2)")
    micro = tokens + rate(pages, PAGE) + rate(field_pages, FIELD_PAGE) + rate(language, LANGUAGE_RECORD) + rate(safety, SAFETY_RECORD)
    return F.round(micro / 1_000_000, 6).cast("double")


#: Chunks that are read at once, pages of a chunk and those it shares with the next, and how much is read twice.
CONCURRENCY, CHUNK_PAGES, SHARED_PAGES = 4, 5, 1
PASSES = 2 * 1.3


def projection(p95_s: Column, pages: Column, tokens_per_page: Column, tokens_per_minute_k: Column) -> Column:
    """struct<chunks, wall_minutes, tokens, quota_minutes>: what a booklet of so many pages would take."""
    chunks = F.greatest(F.lit(1), F.ceil((pages - SHARED_PAGES) / (CHUNK_PAGES - SHARED_PAGES))).cast("bigint")
    wall = F.round(F.ceil(chunks / CONCURRENCY) * p95_s / 60, 1)
    tokens = pages * tokens_per_page * F.lit(PASSES)
    return F.struct(
        chunks.alias("chunks"), wall.alias("wall_minutes"), F.round(tokens).cast("bigint").alias("tokens"), F.round(tokens / (tokens_per_minute_k * 1000), 2).alias("quota_minutes")
    )


def tool_report(calls: DataFrame, durations: DataFrame) -> DataFrame:
    """(tool, executor, calls, errors, error_rate_pct, p95_ms): calls (tool, executor, outcome, n) beside the weighted 95th
    percentile of durations (tool, executor, n, total_ms), null where none was measured."""
    keys = ["tool", "executor"]
    bad = F.col("outcome").isin("error", "rejected")
    per = calls.groupBy(*keys).agg(F.sum("n").alias("calls"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("errors"))
    timed = durations.where("n > 0").withColumn("p95_ms", F.col("total_ms") / F.col("n"))
    p95 = weighted_percentile(timed, keys, "p95_ms", "n", 0.95)
    rate = F.round(100.0 * F.col("errors") / F.col("calls"), 1).alias("error_rate_pct")
    return per.join(p95, keys, "left").select(*keys, "calls", "errors", rate, F.round("p95_ms", 0).alias("p95_ms"))


def budget_alerts(spend: DataFrame, budgets: DataFrame, day: Column, share: float = 80.0) -> DataFrame:
    """(namespace, spent, budget, used_pct): namespaces with a budget of which a day's spend (namespace, ts, amount) has
    used this many percent or more."""
    per = spend.where(F.to_date("ts") == day).groupBy("namespace").agg(F.sum("amount").alias("spent"))
    used = F.round(100.0 * F.col("spent") / F.col("budget"), 1)
    return per.join(bounded(budgets), "namespace").select("namespace", "spent", "budget", used.alias("used_pct")).where(F.col("used_pct") >= share)


def remaining_percent(spent: Column, limit: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(100.0 * (limit - spent) / limit, 2)))


#: Status of each error code.
STATUS = {
    "payload_too_large": 413,
    "unsupported_media_type": 415,
    "pii_detected": 422,
    "unsafe_image": 422,
    "content_filtered": 422,
    "prompt_injection": 422,
    "invalid_request": 400,
    "page_cap_exceeded": 413,
    "booklet_cap_exceeded": 429,
    "rate_limited": 429,
    "budget_exhausted": 429,
    "ai_disabled": 503,
    "upstream_error": 502,
    "internal_error": 500,
}


def status_of(code: Column) -> Column:
    return F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in STATUS.items()], F.lit(500))


#: Which other status a claim may go to from each.
TRANSITIONS = {
    "draft": ["submitted"],
    "submitted": ["paid", "partially_paid", "rejected", "draft"],
    "paid": ["partially_paid", "rejected"],
    "partially_paid": ["paid", "rejected"],
    "rejected": ["paid", "partially_paid"],
}


def may_go(a: Column, b: Column) -> Column:
    """Whether a claim may change from one status to another, or stay as it is; false for unknown ones."""
    return F.coalesce(*[F.when(a == k, b.isin(k, *v)) for k, v in TRANSITIONS.items()], F.lit(False))
