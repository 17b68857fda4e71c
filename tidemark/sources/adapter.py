"""Claims, claim lines and plan dimensions as views over the star schema; the same views in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BENEFITS = 15
#: Fixed values of the plan that the queries use, by benefit number: cents a year, hundredths of a percent.
LIMIT_CENTS = 50_000_00
POOL_CENTS = 120_000_00
DEDUCTIBLE_CENTS = 10_000_00
PERCENT_BP = 8_000
AS_OF = "1999-06-30"
EFFECTIVE = "1994-04-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim_id, member_id, family_id, created, status)"""
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "submitted").otherwise("partially_paid")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("member_id"),
        (F.col("o_custkey") % 100).alias("family_id"), F.to_date("o_orderdate").alias("created"), status.alias("status"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total_cents"),
    )


#: Lines that a task numbers at most, whatever the session's number of partitions: some hundreds of MB with the sorts that follow.
LINES_A_TASK = 1_000_000


def _numbered(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Adds line_id, the line's place in its claim. Partitioned by claim_id itself, so that joins and windows by claim that follow
    take the rows as they lie."""
    key = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    lines = lines.withColumnRenamed("l_orderkey", "claim_id").select("claim_id", *key)
    n = lines.count() // LINES_A_TASK + 1  # from the files' footers
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines = lines.repartition(n, "claim_id")
    # amounts are made of these columns after the sort, not carried through it
    return lines.withColumn("line_id", F.row_number().over(Window.partitionBy("claim_id").orderBy(*key)).cast("bigint"))


def claim_lines(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """(claim_id, [line_id,] benefit_id, service_date, quantity, charged_cents, other_cents)"""
    df = table(spark, sf_dir, "lineitem")
    df = _numbered(spark, df) if numbered else df.withColumnRenamed("l_orderkey", "claim_id")
    return df.select(
        "claim_id", *["line_id"] * numbered, (F.col("l_partkey") % BENEFITS).alias("benefit_id"),
        F.to_date("l_shipdate").alias("service_date"), F.col("l_quantity").cast("bigint").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("charged_cents"),
        F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("bigint").alias("other_cents"),
    )


CLAIMS_SQL = """claims AS (
  SELECT o_orderkey AS claim_id, o_custkey AS member_id, o_custkey % 100 AS family_id, CAST(o_orderdate AS DATE) AS created,
    CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'submitted' ELSE 'partially_paid' END AS status,
    CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents
  FROM orders)"""
LINES_SQL = f"""lines AS (
  SELECT l_orderkey AS claim_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey,
      l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS line_id,
    l_partkey % {BENEFITS} AS benefit_id, CAST(l_shipdate AS DATE) AS service_date, CAST(l_quantity AS BIGINT) AS quantity,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS charged_cents,
    CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS other_cents
  FROM lineitem)"""
