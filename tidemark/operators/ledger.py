"""Usage over a claims ledger: scoped sums in windows, what remains of limits and pools, frequencies, cost shares.

A ledger is a DataFrame with (member_id, benefit_id, service_date, quantity, paid_cents) and what else a query needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import div, percent_of

COUNTED = ("paid", "partially_paid")


def counted_claims(claims: DataFrame, include_submitted: bool) -> DataFrame:
    return claims.where(F.col("status").isin(*COUNTED, *["submitted"] * include_submitted))


def measure(unit: str) -> Column:
    """What an entry counts towards a limit: cents paid, or its quantity if anything was paid."""
    return F.col("paid_cents") if unit == "cents" else F.when(F.col("paid_cents") > 0, F.col("quantity")).otherwise(0)


def in_window(window: Column, date: str = "service_date") -> Column:
    return F.col(date).between(window["start"], window["end"])


def scoped_sum(ledger: DataFrame, scope: str, keys: list[str], window: Column, unit: str = "cents") -> DataFrame:
    """(keys, owner, used): sums of a window by owner, which is the member or, in wider scopes, the family."""
    owner = F.col("member_id" if scope == "per_person" else "family_id").alias("owner")
    return ledger.where(in_window(window)).groupBy(*keys, owner).agg(F.sum(measure(unit)).cast("bigint").alias("used"))


def remaining(limit: Column | int, used: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), (limit if isinstance(limit, Column) else F.lit(limit).cast("bigint")) - used)


def pool_members(pools: DataFrame, benefits: DataFrame) -> DataFrame:
    """(pool_id, benefit_id): a benefit's own pool, else the first pool that lists it.

    ``pools`` has (pool_id, place, benefit_ids), ``benefits`` has (benefit_id, pool_id).
    """
    listed = pools.select("pool_id", "place", F.explode("benefit_ids").alias("benefit_id"))
    first = listed.groupBy("benefit_id").agg(F.min_by("pool_id", "place").alias("first_pool"))
    known = pools.select(F.col("pool_id").alias("own_pool"))
    own = benefits.select("benefit_id", F.col("pool_id").alias("named")).join(known, F.col("named") == known.own_pool, "left")
    both = own.join(first, "benefit_id", "left")
    return both.select(F.coalesce("own_pool", "first_pool").alias("pool_id"), "benefit_id").dropna()


def cost_share_targets(benefits: DataFrame, shares: DataFrame) -> DataFrame:
    """(benefit_id, share_id): by the benefit's list, the share's list of benefits, or its list of categories.

    Three equality joins and a union stand for the OR, which could only be a nested loop.
    """
    b = benefits.select("benefit_id", "category_id", "share_ids")
    by_benefit = b.select("benefit_id", F.explode("share_ids").alias("share_id")).join(shares.select("share_id"), "share_id")
    by_share = shares.select("share_id", F.explode("benefit_ids").alias("benefit_id")).join(b.select("benefit_id"), "benefit_id")
    by_category = shares.select("share_id", F.explode("category_ids").alias("category_id")).join(b, "category_id")
    cols = ["benefit_id", "share_id"]
    return by_benefit.select(*cols).union(by_share.select(*cols)).union(by_category.select(*cols)).distinct()


def frequency_usage(ledger: DataFrame, count: int, months: int, as_of: Column, keys: list[str]) -> DataFrame:
    """(keys, used, next_eligible) for ``count`` services in any ``months`` months.

    An entry counts once for each unit begun. Over the count, the service that has to leave the window is the
    ``used - count``-th oldest; the next day on which it has left is the eligible one.
    """
    start = F.date_add(F.add_months(as_of, -months), 1)
    inside = ledger.where((F.col("paid_cents") > 0) & F.col("service_date").between(start, as_of))
    # equal dates are summed first, so that what is listed is days of the window, not services
    times = F.greatest(F.lit(1), F.ceil("quantity")).cast("bigint")
    days = inside.groupBy(*keys, "service_date").agg(F.sum(times).alias("n"))
    per = days.groupBy(*keys).agg(
        F.sum("n").cast("bigint").alias("used"), F.sort_array(F.collect_list(F.struct("service_date", "n"))).alias("days")
    )
    skip = F.col("used") - count
    # the first day up to which more than ``skip`` services were counted
    found = F.aggregate(
        "days",
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("date").alias("day")),
        lambda a, d: F.struct(
            (a["seen"] + d["n"]).alias("seen"),
            F.when(a["day"].isNull() & (a["seen"] + d["n"] > skip), d["service_date"]).otherwise(a["day"]).alias("day"),
        ),
    )["day"]
    after = F.add_months(found, months)
    # clamped month ends can leave the service inside for some days more
    day = lambda k: F.date_add(after, k)
    free = F.coalesce(*[F.when(found <= F.add_months(day(k), -months), day(k)) for k in range(4)])
    return per.select(*keys, "used", F.when(F.col("used") >= count, free).alias("next_eligible"))


def capped_prefix(df: DataFrame, keys: list[str], order: list[str], amount: str, cap: Column | int, out: str) -> DataFrame:
    """Adds what each row still gets of a cap that earlier rows use up: a difference of clamped running sums."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    limit = (cap if isinstance(cap, Column) else F.lit(cap)).cast("bigint")
    run = F.sum(amount).over(w)
    return df.withColumn(out, (F.least(limit, run) - F.least(limit, run - F.col(amount))).cast("bigint"))


def raw_reimbursement(bp: int = 8_000) -> Column:
    """Share of the charge, at most what the other plan left."""
    balance = F.col("charged_cents") - F.least("charged_cents", "other_cents")
    return F.least(percent_of(F.col("charged_cents"), bp), balance)


def member_headline(usage: DataFrame, every: bool = False) -> DataFrame:
    """(member_id, remaining_cents, paid_cents, used_benefits) from usage rows by benefit.

    ``usage``: member_id, benefit_id, used_cents, own_remaining (null: unlimited), pool_id, pool_remaining, and ``waiting`` if
    it is to be over every benefit that waits for nothing instead of the used ones. A pool counts once, as the lesser of its
    remainder and the sum of what its benefits have left; unlimited ones without a pool are left out. What was paid and how
    many were used is told of all rows.
    """
    used = ~F.col("waiting") if every else F.col("used_cents") > 0
    in_pool = F.col("pool_id").isNotNull()
    per_pool = (
        usage.where(used)
        .groupBy("member_id", F.when(in_pool, F.col("pool_id")).alias("pool_id"))
        .agg(
            F.sum(F.coalesce("own_remaining", F.when(in_pool, F.col("pool_remaining")))).alias("own"),
            F.first("pool_remaining").alias("pool_remaining"),
        )
    )
    part = F.when(F.col("pool_id").isNotNull(), F.least("own", "pool_remaining")).otherwise(F.coalesce("own", F.lit(0)))
    left = per_pool.groupBy("member_id").agg(F.sum(part).cast("bigint").alias("remaining_cents"))
    told = usage.groupBy("member_id").agg(F.sum("used_cents").cast("bigint").alias("paid_cents"), F.count_if(F.col("used_cents") > 0).alias("used_benefits"))
    remaining_cents = F.coalesce("remaining_cents", F.lit(0).cast("bigint")).alias("remaining_cents")
    return told.join(left, "member_id", "left").select("member_id", remaining_cents, "paid_cents", "used_benefits")


#: Statuses of claims that are decided, and the order in which statuses are listed.
DECIDED = ("paid", "partially_paid", "rejected")
STATUS_ORDER = ("draft", "submitted", "partially_paid", "paid", "rejected")


def claims_by_status(claims: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, place, n, charged_cents, paid_cents): claims (keys, status, charged_cents, paid_cents or null) by
    status; ``place`` is that of the fixed order, and statuses without claims are left out."""
    per = claims.groupBy(*keys, "status").agg(
        F.count("*").alias("n"), F.sum("charged_cents").alias("charged_cents"), F.sum(F.coalesce("paid_cents", F.lit(0))).cast("bigint").alias("paid_cents")
    )
    return per.withColumn("place", F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status")))


def listed(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``row``, a claim's place among those of its keys and status: the latest service first, then the latest change."""
    w = Window.partitionBy(*keys, "status").orderBy(F.col("last_service").desc_nulls_last(), F.desc("updated"), "claim_id")
    return claims.withColumn("row", F.row_number().over(w))


def claim_kpis(claims: DataFrame, quotes: DataFrame, year_start: Column) -> DataFrame:
    """(member_id, paid_cents, awaiting_cents, decided, drafts): what was paid for claims whose last service is in the year or
    later, what submitted claims are estimated to pay, each on the ledger of the others, and how many were decided.

    ``claims`` (claim_id, member_id, status, last_service, paid_cents or null without an outcome), ``quotes`` (claim_id, pays).
    """
    expected = quotes.groupBy("claim_id").agg(F.sum("pays").alias("__pays"))
    rows = claims.join(expected, "claim_id", "left")
    in_year = F.col("last_service") >= year_start
    return rows.groupBy("member_id").agg(
        F.sum(F.when(in_year, F.coalesce("paid_cents", F.lit(0))).otherwise(0)).cast("bigint").alias("paid_cents"),
        F.sum(F.when(F.col("status") == "submitted", F.coalesce("__pays", F.lit(0))).otherwise(0)).cast("bigint").alias("awaiting_cents"),
        F.count_if(in_year & F.col("paid_cents").isNotNull()).alias("decided"), F.count_if(F.col("status") == "draft").alias("drafts"),
    )


def out_of_pocket(claims: DataFrame, lines: DataFrame, start: Column, end: Column) -> DataFrame:
    """(member_id, out_of_pocket_cents): over decided claims, rejected ones too, with a service from ``start`` to ``end``
    (the plan's period), what was neither paid by this plan nor by another, 0 at least for each claim. ``claims`` has
    paid_cents, null if nothing was paid.
    """
    per = lines.groupBy("claim_id").agg(
        F.sum(F.col("charged_cents") - F.coalesce("other_cents", F.lit(0))).alias("open"),
        F.bool_or(F.col("service_date").between(start, end)).alias("touches"),
    )
    joined = claims.where(F.col("status").isin(*DECIDED)).join(per.where("touches"), "claim_id")
    owed = F.greatest(F.lit(0), F.col("open") - F.coalesce("paid_cents", F.lit(0)))
    return joined.groupBy("member_id").agg(F.sum(owed).cast("bigint").alias("out_of_pocket_cents"))


def shares_by_hundred(cents: Column, percent: int) -> Column:
    """Whole cents of a percentage, rounded down."""
    return div(cents * percent, 100)
