"""What each member has of each benefit, dense over both, and lists and totals made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import bounded


def without_claim(claims: DataFrame, plan: Column, excluded: Column) -> DataFrame:
    """Claims of a plan, but for one that is being estimated anew; null excludes none."""
    return claims.where((F.col("plan_id") == plan) & ~F.coalesce(F.col("claim_id") == excluded, F.lit(False)))


def dense_usage(members: DataFrame, benefits: DataFrame, used: DataFrame, as_of: Column) -> DataFrame:
    """(plan_id, member_id, benefit_id, used_cents, remaining_cents, waiting_ends, waiting): every member with every
    benefit of the plan, used or not.

    ``members`` (plan_id, member_id, coverage_start), ``benefits`` (plan_id, benefit_id, limit_cents or null,
    waiting_months, effective), of which a plan has few; ``used`` (plan_id, member_id, benefit_id, used_cents).
    """
    every = members.join(bounded(benefits), "plan_id")
    rows = every.join(used, ["plan_id", "member_id", "benefit_id"], "left")
    spent = F.coalesce("used_cents", F.lit(0)).cast("bigint")
    ends = F.when(F.col("waiting_months") > 0, F.add_months(F.coalesce("coverage_start", "effective"), F.col("waiting_months").cast("int")))
    return rows.select(
        "plan_id", "member_id", "benefit_id", spent.alias("used_cents"),
        F.when(F.col("limit_cents").isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.col("limit_cents") - spent)).alias("remaining_cents"),
        ends.alias("waiting_ends"), F.coalesce(as_of < ends, F.lit(False)).alias("waiting"),
    )


def shown(usage: DataFrame, every: bool = False) -> DataFrame:
    """Rows of ``dense_usage`` that a member's headline is made of: the used ones, or every one that waits for nothing."""
    return usage.where(~F.col("waiting") if every else F.col("used_cents") > 0)


def schedule_lists(usage: DataFrame, benefits: DataFrame) -> DataFrame:
    """(plan_id, member_id, benefit_id, list): benefits with a rule of frequency, in the list ``frequency``; those with a
    waiting period in ``waiting`` until it is served, then in ``served``. A benefit may be in two."""
    rules = bounded(benefits.select("plan_id", "benefit_id", "frequency", "waiting_months"))
    rows = usage.join(rules, ["plan_id", "benefit_id"])
    lists = F.array_compact(
        F.array(
            F.when(F.col("frequency").isNotNull(), "frequency"),
            F.when(F.col("waiting_months") > 0, F.when(F.col("waiting"), "waiting").otherwise("served")),
        )
    )
    return rows.select("plan_id", "member_id", "benefit_id", F.explode(lists).alias("list"))
