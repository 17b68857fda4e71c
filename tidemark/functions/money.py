"""Exact cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Integer division of longs, towards 0."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def half_up(numerator: Column, denominator: Column | int = 1) -> Column:
    """Integer division, halves up, for numerators of 0 or more."""
    d = denominator if isinstance(denominator, Column) else F.lit(denominator)
    return div(2 * numerator + d, 2 * d)


def percent_of(cents: Column, basis_points: Column | int) -> Column:
    """Share of cents by hundredths of a percent, halves up, in long arithmetic."""
    bp = basis_points if isinstance(basis_points, Column) else F.lit(basis_points)
    return half_up(cents * bp, 10_000)


def dollars_to_cents(dollars: Column) -> Column:
    """Halves away from 0, by decimal arithmetic."""
    return (F.round(dollars.cast("decimal(18,4)") * 100)).cast("bigint")


def clamp(x: Column, low: Column | int, high: Column | int) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(lo, F.least(hi, x))


def allocate(df: DataFrame, group: list[str], order: list[str], total: str, weight: str, out: str = "part") -> DataFrame:
    """Split each group's ``total`` over its rows by ``weight``: integer parts by largest remainder, exact in sum.

    Negative weights count 0; without any weight the first row gets all. Ties go by ``order``.
    """
    of = Window.partitionBy(*group)
    weights = F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("decimal(28,0)")
    df = df.withColumn("__w", weights).withColumn("__s", F.sum("__w").over(of).cast("decimal(28,0)"))
    product = F.col(total).cast("decimal(18,0)") * F.col("__w").cast("decimal(19,0)")
    df = df.withColumn("__r", product % F.nullif("__s", F.lit(0)))  # null: no weight at all
    df = df.withColumn("__p", F.when(F.col("__s") == 0, F.col(total) * 0).otherwise((product - F.col("__r")) / F.nullif("__s", F.lit(0))).cast("bigint"))
    # one sort, of few columns: sums of a group need none of their own on either side of it
    df = df.drop("__w", "__s").withColumn("__k", F.row_number().over(of.orderBy(F.desc("__r"), *order)))
    df = df.withColumn("__left", F.col(total) - F.sum("__p").over(of))
    first = F.when(F.col("__k") == 1, F.col(total)).otherwise(0)
    more = F.when(F.col("__r").isNull(), first).when(F.col("__k") <= F.col("__left"), 1).otherwise(0)
    return df.withColumn(out, (F.col("__p") + more).cast("bigint")).drop("__r", "__p", "__k", "__left")
