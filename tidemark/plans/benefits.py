"""Queries over claims, limits and periods."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import temporal as T
from ..functions.money import allocate, div
from ..operators import fold, ledger
from ..operators.joins import bounded
from ..sources.adapter import (
    AS_OF,
    BENEFITS,
    CLAIMS_SQL,
    DEDUCTIBLE_CENTS,
    EFFECTIVE,
    LIMIT_CENTS,
    LINES_SQL,
    PERCENT_BP,
    POOL_CENTS,
    claim_lines,
    claims,
    table,
)

_D = lambda s: F.lit(s).cast("date")


def the_plan() -> T.Plan:
    """A plan whose benefit year begins in July."""
    return T.Plan(_D(EFFECTIVE), F.lit("benefit_year"), F.lit(7), F.lit(1))


RAW_SQL = f"least((2 * charged_cents * {PERCENT_BP} + 10000) // 20000, charged_cents - least(charged_cents, other_cents))"


def _anchor(y: str, m: str, d: str) -> str:
    return f"make_date(({y})::BIGINT, ({m})::BIGINT, least({d}, day(last_day(make_date(({y})::BIGINT, ({m})::BIGINT, 1)))))"


def _first(d: str, m: str, day: str) -> str:
    return f"(CASE WHEN {_anchor(f'year({d})', m, day)} <= {d} THEN year({d}) ELSE year({d}) - 1 END)"


def period_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    m = F.col("member_id")
    eff = F.make_date((1992 + m % 5).cast("int"), (m % 12 + 1).cast("int"), F.least(m % 31 + 1, F.lit(28)).cast("int"))
    kind = F.when(m % 3 == 0, "benefit_year").when(m % 3 == 1, "policy_anniversary").otherwise("lifetime")
    c = c.select("claim_id", F.col("created").alias("d"), eff.alias("eff"), kind.alias("kind"), F.when(m % 2 == 0, F.lit(7)).alias("sm"))
    plan = T.Plan(F.col("eff"), F.col("kind"), F.col("sm"), F.lit(31))
    month, day = T.benefit_year_anchor(T.Period("benefit_year"), plan)
    c = c.withColumns({"am": month, "ad": day})  # named, so that they are made once
    d, year = F.col("d"), T.Period("benefit_year", start_month=F.col("am"), start_day=F.col("ad"))
    runs = T.Period("consecutive_benefit_years", years=3, start_month=F.col("am"), start_day=F.col("ad"))
    windows = {
        "own": T.period_window(T.Period("benefit_year", start_month=2, start_day=29), d, plan), "year": T.period_window(year, d, plan),
        "ann": T.period_window(T.Period("policy_anniversary"), d, plan), "rolling": T.period_window(T.Period("rolling_months", months=18), d, plan),
        "run": T.period_window(runs, d, plan), "life": T.period_window(T.Period("lifetime"), d, plan),
        "visit": T.period_window(T.Period("per_visit"), d, plan), "current": T.current_period(d, plan),
    }
    w = c.withColumns(windows)
    return w.select(
        "claim_id", *[F.col(f"{n}.{e}").alias(f"{n}_{e}") for n in ("own", "year", "ann", "run") for e in ("start", "end")],
        F.col("rolling.start").alias("rolling_start"), F.col("life.end").cast("string").alias("life_end"), F.col("visit.start").alias("visit_start"),
        F.col("current.start").alias("current_start"), F.date_add("year.end", 1).alias("next_reset"),
        T.waiting_ends(F.lit(6), F.lit(None).cast("date"), F.col("eff")).alias("waiting_ends"),
        T.days_in_month(F.year("d"), F.month("d")).alias("days_in_month"), T.is_leap_year(F.year("d")).alias("leap"),
    )


_PW_MONTH = "CASE WHEN kind = 'benefit_year' AND sm IS NOT NULL THEN sm WHEN kind = 'policy_anniversary' THEN month(eff) ELSE 1 END"
_PW_DAY = "CASE WHEN kind = 'benefit_year' AND sm IS NOT NULL THEN 31 WHEN kind = 'policy_anniversary' THEN day(eff) ELSE 1 END"
PERIOD_WINDOWS_SQL = f"""WITH {CLAIMS_SQL}, p AS (
  SELECT claim_id, created AS d, make_date(1992 + member_id % 5, member_id % 12 + 1, least(member_id % 31 + 1, 28)) AS eff,
    CASE member_id % 3 WHEN 0 THEN 'benefit_year' WHEN 1 THEN 'policy_anniversary' ELSE 'lifetime' END AS kind,
    CASE WHEN member_id % 2 = 0 THEN 7 END AS sm FROM claims),
q AS (SELECT *, {_PW_MONTH} AS am, {_PW_DAY} AS ad FROM p),
r AS (SELECT *, {_first('d', '2', '29')} AS oy, {_first('d', 'am', 'ad')} AS iy, {_first('d', 'month(eff)', 'day(eff)')} AS ay,
  {_first('eff', 'am', 'ad')} AS fy FROM q),
s AS (SELECT *, fy + CAST(floor((iy - fy) / 3.0) AS BIGINT) * 3 AS ry FROM r)
SELECT claim_id, {_anchor('oy', '2', '29')} AS own_start, {_anchor('oy + 1', '2', '29')} - 1 AS own_end,
  {_anchor('iy', 'am', 'ad')} AS year_start, {_anchor('iy + 1', 'am', 'ad')} - 1 AS year_end,
  {_anchor('ay', 'month(eff)', 'day(eff)')} AS ann_start, {_anchor('ay + 1', 'month(eff)', 'day(eff)')} - 1 AS ann_end,
  CAST(d - INTERVAL 18 MONTH AS DATE) + 1 AS rolling_start,
  {_anchor('ry', 'am', 'ad')} AS run_start, {_anchor('ry + 3', 'am', 'ad')} - 1 AS run_end,
  '9999-12-31' AS life_end, CAST(NULL AS DATE) AS visit_start,
  CASE kind WHEN 'lifetime' THEN make_date(year(d), 1, 1) WHEN 'policy_anniversary' THEN {_anchor('ay', 'month(eff)', 'day(eff)')}
    ELSE {_anchor('iy', 'am', 'ad')} END AS current_start,
  {_anchor('iy + 1', 'am', 'ad')} AS next_reset, CAST(eff + INTERVAL 6 MONTH AS DATE) AS waiting_ends,
  CAST(day(last_day(d)) AS INTEGER) AS days_in_month, day(last_day(make_date(year(d), 2, 1))) = 29 AS leap FROM s"""


def claim_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = T.claim_deadline(F.col("service_date"), the_plan(), F.lit(365), F.lit(90))
    lines = claim_lines(spark, sf_dir)
    per = lines.groupBy("claim_id").agg(
        F.min(due).alias("deadline"), F.min("service_date").alias("first_service"), F.max("service_date").alias("last_service")
    )
    left = F.datediff("deadline", _D(AS_OF))
    tone = F.when(left < 0, "passed").when(left <= 30, "soon").otherwise("later")
    return per.select("*", left.cast("bigint").alias("days_left"), tone.alias("tone"))


CLAIM_DEADLINES_SQL = f"""WITH {LINES_SQL}, d AS (
  SELECT claim_id, service_date, greatest(service_date + 365,
    make_date({_first('service_date', '7', '1')} + 1, 7, 1) - 1 + 90) AS due FROM lines),
p AS (SELECT claim_id, min(due) AS deadline, min(service_date) AS first_service, max(service_date) AS last_service FROM d GROUP BY 1)
SELECT *, CAST(date_diff('day', DATE '{AS_OF}', deadline) AS BIGINT) AS days_left,
  CASE WHEN deadline < DATE '{AS_OF}' THEN 'passed' WHEN deadline <= DATE '{AS_OF}' + 30 THEN 'soon' ELSE 'later' END AS tone FROM p"""


def counted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by status, every seventh one rejected and every eleventh a draft, in the fixed order, with the newest of each."""
    c, k = claims(spark, sf_dir), F.col("claim_id")
    status = F.when(k % 7 == 0, "rejected").when(k % 11 == 0, "draft").otherwise(F.col("status"))
    c = c.withColumn("status", status)
    c = c.select(
        "claim_id", "status", F.col("total_cents").alias("charged_cents"), F.when(F.col("status").isin("paid", "partially_paid"), div(F.col("total_cents"), 2)).alias("paid_cents"),
        F.when(k % 5 != 0, F.col("created")).alias("last_service"), F.col("created").alias("updated"),
    )
    newest = ledger.listed(c, []).where("row = 1").select("status", F.col("claim_id").alias("newest"))
    return ledger.claims_by_status(c, []).join(F.broadcast(newest), "status")


COUNTED_CLAIMS_SQL = f"""WITH {CLAIMS_SQL}, c AS (SELECT claim_id, created, total_cents, CASE WHEN claim_id % 7 = 0 THEN 'rejected' WHEN claim_id % 11 = 0 THEN 'draft' ELSE status END AS status FROM claims),
r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY CASE WHEN claim_id % 5 <> 0 THEN created END DESC NULLS LAST, created DESC, claim_id) AS n FROM c)
SELECT status, count(*) AS n, CAST(sum(total_cents) AS BIGINT) AS charged_cents, CAST(sum(CASE WHEN status IN ('paid', 'partially_paid') THEN total_cents // 2 ELSE 0 END) AS BIGINT) AS paid_cents,
  CAST(list_position(['draft', 'submitted', 'partially_paid', 'paid', 'rejected'], status) AS BIGINT) AS place, max(claim_id) FILTER (r.n = 1) AS newest FROM r GROUP BY 1"""


def paid_lines(spark: SparkSession, sf_dir: str, include_submitted: bool = True) -> DataFrame:
    """Ledger entries of counted claims, each paid what its charge alone gives."""
    counted = ledger.counted_claims(claims(spark, sf_dir), include_submitted).select("claim_id", "member_id", "family_id", "status", "created")
    lines = claim_lines(spark, sf_dir).withColumn("paid_cents", ledger.raw_reimbursement(PERCENT_BP))
    return lines.join(counted, "claim_id")


def _paid_sql(include_submitted: bool = True) -> str:
    where = "" if include_submitted else " WHERE status <> 'submitted'"
    return f"{CLAIMS_SQL}, {LINES_SQL}, paid AS (SELECT *, {RAW_SQL} AS paid_cents FROM lines JOIN claims USING (claim_id){where})"


def limit_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = T.period_window(T.Period("benefit_year"), _D(AS_OF), the_plan())
    used = ledger.scoped_sum(paid_lines(spark, sf_dir), "per_person", ["benefit_id"], window)
    return used.select(
        F.col("owner").alias("member_id"), "benefit_id", window["start"].alias("window_start"), window["end"].alias("window_end"),
        F.col("used").alias("used_cents"), ledger.remaining(LIMIT_CENTS, F.col("used")).alias("remaining_cents"),
    )


LIMIT_USAGE_SQL = f"""WITH {_paid_sql()}
SELECT member_id, benefit_id, DATE '1998-07-01' AS window_start, DATE '1999-06-30' AS window_end,
  CAST(sum(paid_cents) AS BIGINT) AS used_cents, CAST(greatest(0, {LIMIT_CENTS} - sum(paid_cents)) AS BIGINT) AS remaining_cents
FROM paid WHERE service_date BETWEEN DATE '1998-07-01' AND DATE '1999-06-30' GROUP BY 1, 2"""


def _dimensions(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    pools = spark.createDataFrame(
        [("P0", 0, [0, 1, 2, 3, 4]), ("P1", 1, [3, 4, 5, 6, 7]), ("P2", 2, [8])], "pool_id string, place int, benefit_ids array<bigint>"
    )
    named = F.when(F.col("id") == 4, "P2").when(F.col("id") == 9, "P1").when(F.col("id") == 10, "P9")
    return pools, spark.range(BENEFITS).select(F.col("id").alias("benefit_id"), named.alias("pool_id"))


_POOL_SQL = """pool AS (SELECT * FROM (VALUES ('P0', 0), ('P0', 1), ('P0', 2), ('P0', 3), ('P2', 4), ('P1', 5), ('P1', 6),
  ('P1', 7), ('P2', 8), ('P1', 9)) t(pool_id, benefit_id))"""


def pool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = ledger.pool_members(*_dimensions(spark))
    window = T.period_window(T.Period("benefit_year", start_month=1), _D(AS_OF), the_plan())
    entries = paid_lines(spark, sf_dir).join(bounded(members), "benefit_id")  # at most a row a benefit
    used = ledger.scoped_sum(entries, "per_family", ["pool_id"], window)
    return used.select(
        "pool_id", F.col("owner").alias("family_id"), F.col("used").alias("used_cents"),
        ledger.remaining(POOL_CENTS, F.col("used")).alias("remaining_cents"),
    )


POOL_USAGE_SQL = f"""WITH {_paid_sql()}, {_POOL_SQL}
SELECT pool_id, family_id, CAST(sum(paid_cents) AS BIGINT) AS used_cents,
  CAST(greatest(0, {POOL_CENTS} - sum(paid_cents)) AS BIGINT) AS remaining_cents
FROM paid JOIN pool USING (benefit_id) WHERE year(service_date) = 1999 GROUP BY 1, 2"""


def plan_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benefits with their pool and the shares that apply, over brands as benefits and types as categories."""
    part = table(spark, sf_dir, "part")
    benefits = part.select(
        F.col("p_brand").alias("benefit_id"), F.col("p_type").alias("category_id"),
    ).distinct().withColumn("share_ids", F.when(F.col("benefit_id") == "Brand#3", F.array(F.lit("S1"))).otherwise(F.array().cast("array<string>")))
    shares = spark.createDataFrame(
        [("S1", ["Brand#1", "Brand#2"], []), ("S2", [], ["ECONOMY"]), ("S3", ["Brand#4"], ["STANDARD", "ECONOMY"])],
        "share_id string, benefit_ids array<string>, category_ids array<string>",
    )
    return ledger.cost_share_targets(benefits, shares)


PLAN_BRIDGES_SQL = """WITH b AS (SELECT DISTINCT p_brand AS benefit_id, p_type AS category_id FROM part)
SELECT DISTINCT benefit_id, share_id FROM b, (VALUES ('S1'), ('S2'), ('S3')) s(share_id) WHERE
  (share_id = 'S1' AND benefit_id IN ('Brand#1', 'Brand#2', 'Brand#3')) OR (share_id = 'S2' AND category_id = 'ECONOMY')
  OR (share_id = 'S3' AND (benefit_id = 'Brand#4' OR category_id IN ('STANDARD', 'ECONOMY')))"""


def frequency_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.frequency_usage(paid_lines(spark, sf_dir), 40, 24, _D(AS_OF), ["member_id", "benefit_id"])


FREQUENCY_USAGE_SQL = f"""WITH {_paid_sql()}, d AS (
  SELECT member_id, benefit_id, service_date, sum(greatest(1, quantity)) AS n FROM paid
  WHERE paid_cents > 0 AND service_date BETWEEN DATE '1997-07-01' AND DATE '{AS_OF}' GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER (PARTITION BY member_id, benefit_id ORDER BY service_date) AS seen,
  sum(n) OVER (PARTITION BY member_id, benefit_id) AS used FROM d),
f AS (SELECT member_id, benefit_id, CAST(max(used) AS BIGINT) AS used, min(service_date) FILTER (seen > used - 40) AS b
  FROM r GROUP BY 1, 2),
g AS (SELECT *, CAST(b + INTERVAL 24 MONTH AS DATE) AS a FROM f)
SELECT member_id, benefit_id, used, CASE WHEN used >= 40 THEN
  CASE WHEN b <= CAST(a - INTERVAL 24 MONTH AS DATE) THEN a WHEN b <= CAST(a + 1 - INTERVAL 24 MONTH AS DATE) THEN a + 1
    ELSE a + 2 END END AS next_eligible FROM g"""

_ORDERED = ["first_service", "created", "claim_id", "service_date", "line_id"]


def ordered_lines(spark: SparkSession, sf_dir: str, include_submitted: bool = True) -> DataFrame:
    """Counted lines with what replay order needs."""
    from pyspark.sql import Window

    lines = claim_lines(spark, sf_dir, numbered=True)
    first = F.min("service_date").over(Window.partitionBy("claim_id"))
    counted = ledger.counted_claims(claims(spark, sf_dir), include_submitted)
    df = lines.withColumn("first_service", first).withColumn("paid_cents", ledger.raw_reimbursement(PERCENT_BP))
    return df.join(counted, "claim_id").withColumn("year", F.year("service_date"))


_ORDERED_SQL = f"""{_paid_sql()}, o AS (SELECT *, min(service_date) OVER (PARTITION BY claim_id) AS first_service,
  year(service_date) AS year FROM paid)"""
_RUN_SQL = "ORDER BY first_service, created, claim_id, service_date, line_id ROWS UNBOUNDED PRECEDING"


def deductible_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ordered_lines(spark, sf_dir).withColumn("balance", F.col("charged_cents") - F.least("charged_cents", "other_cents"))
    out = ledger.capped_prefix(df, ["member_id", "year"], _ORDERED, "balance", DEDUCTIBLE_CENTS, "applied_cents")
    return out.select("claim_id", "line_id", "member_id", "applied_cents")


DEDUCTIBLE_SQL = f"""WITH {_ORDERED_SQL}, b AS (SELECT *, charged_cents - least(charged_cents, other_cents) AS balance FROM o),
r AS (SELECT *, sum(balance) OVER (PARTITION BY member_id, year {_RUN_SQL}) AS run FROM b)
SELECT claim_id, line_id, member_id, CAST(least({DEDUCTIBLE_CENTS}, run) - least({DEDUCTIBLE_CENTS}, run - balance) AS BIGINT) AS applied_cents
FROM r"""


def capped_reimbursement(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ordered_lines(spark, sf_dir)
    out = ledger.capped_prefix(df, ["member_id", "benefit_id", "year"], _ORDERED, "paid_cents", LIMIT_CENTS, "pays_cents")
    return out.select("claim_id", "line_id", "benefit_id", "paid_cents", "pays_cents")


CAPPED_SQL = f"""WITH {_ORDERED_SQL}, r AS (
  SELECT *, sum(paid_cents) OVER (PARTITION BY member_id, benefit_id, year {_RUN_SQL}) AS run FROM o)
SELECT claim_id, line_id, benefit_id, paid_cents, CAST(least({LIMIT_CENTS}, run) - least({LIMIT_CENTS}, run - paid_cents) AS BIGINT) AS pays_cents FROM r"""


def allocate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ordered_lines(spark, sf_dir, include_submitted=False).withColumn("outcome", div(F.col("total_cents") * 3, 5))
    out = allocate(df, ["claim_id"], ["line_id"], "outcome", "paid_cents", "part_cents")
    return out.select("claim_id", "line_id", "outcome", "part_cents")


ALLOCATE_SQL = f"""WITH {_paid_sql(False)}, w AS (
  SELECT claim_id, line_id, total_cents * 3 // 5 AS outcome, paid_cents AS weight, sum(paid_cents) OVER (PARTITION BY claim_id) AS s FROM paid),
v AS (SELECT claim_id, line_id, outcome, CASE WHEN s > 0 THEN weight WHEN line_id = 1 THEN 1 ELSE 0 END AS weight,
  CASE WHEN s > 0 THEN s ELSE 1 END AS s FROM w),
p AS (SELECT *, (CAST(outcome AS HUGEINT) * weight) // s AS part, (CAST(outcome AS HUGEINT) * weight) % s AS r FROM v),
k AS (SELECT *, outcome - sum(part) OVER (PARTITION BY claim_id) AS spare,
  row_number() OVER (PARTITION BY claim_id ORDER BY r DESC, line_id) AS place FROM p)
SELECT claim_id, line_id, outcome, CAST(part + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS part_cents FROM k"""


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by member and benefit: benefits 0, 3, 6 and so on have no limit of their own; pools are of the member."""
    from pyspark.sql import Window

    year = T.period_window(T.Period("benefit_year", start_month=1), _D(AS_OF), the_plan())
    used = ledger.scoped_sum(paid_lines(spark, sf_dir), "per_person", ["benefit_id"], year)
    used = used.join(bounded(ledger.pool_members(*_dimensions(spark))), "benefit_id", "left")
    in_pool = F.sum("used").over(Window.partitionBy("owner", "pool_id"))
    return used.select(
        F.col("owner").alias("member_id"), "benefit_id", F.col("used").alias("used_cents"),
        F.when(F.col("benefit_id") % 3 != 0, ledger.remaining(LIMIT_CENTS, F.col("used"))).alias("own_remaining"),
        "pool_id", F.when(F.col("pool_id").isNotNull(), ledger.remaining(POOL_CENTS, in_pool)).alias("pool_remaining"),
    )


def member_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over used benefits, and over all that a member has rows of and that wait for nothing."""
    rows = usage_rows(spark, sf_dir).withColumn("waiting", F.col("benefit_id") == 4)
    per = [ledger.member_headline(rows, every).withColumn("every", F.lit(every)) for every in (False, True)]
    return per[0].unionByName(per[1])


HEADLINE_SQL = f"""WITH {_paid_sql()}, {_POOL_SQL}, u AS (
  SELECT member_id, benefit_id, sum(paid_cents) AS used FROM paid WHERE year(service_date) = 1999 GROUP BY 1, 2),
v AS (SELECT u.*, pool_id, CASE WHEN u.benefit_id % 3 <> 0 THEN greatest(0, {LIMIT_CENTS} - used) END AS own,
  CASE WHEN pool_id IS NOT NULL THEN greatest(0, {POOL_CENTS} - sum(used) OVER (PARTITION BY member_id, pool_id)) END AS left_in_pool
  FROM u LEFT JOIN pool USING (benefit_id)),
e AS (SELECT unnest([false, true]) AS every),
g AS (SELECT every, member_id, pool_id, sum(coalesce(own, left_in_pool)) AS own, max(left_in_pool) AS left_in_pool
  FROM v, e WHERE CASE WHEN every THEN benefit_id <> 4 ELSE used > 0 END GROUP BY 1, 2, 3),
r AS (SELECT every, member_id, sum(CASE WHEN pool_id IS NULL THEN coalesce(own, 0) ELSE least(own, left_in_pool) END) AS remaining FROM g GROUP BY 1, 2),
t AS (SELECT member_id, sum(used) AS paid, count(*) FILTER (used > 0) AS n FROM v GROUP BY 1)
SELECT t.member_id, CAST(coalesce(remaining, 0) AS BIGINT) AS remaining_cents, CAST(paid AS BIGINT) AS paid_cents, CAST(n AS BIGINT) AS used_benefits, e.every
FROM t CROSS JOIN e LEFT JOIN r ON r.member_id = t.member_id AND r.every = e.every"""


def out_of_pocket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a plan's year that begins on April 1; every seventh claim rejected, with nothing paid."""
    rejected = F.col("claim_id") % 7 == 0
    c = claims(spark, sf_dir).withColumns({"paid_cents": F.when(~rejected, div(F.col("total_cents") * 3, 5)), "status": F.when(rejected, "rejected").otherwise(F.col("status"))})
    window = T.current_period(_D("1998-05-05"), T.Plan(_D("1990-01-31"), F.lit("benefit_year"), F.lit(4), F.lit(1)))
    return ledger.out_of_pocket(c, claim_lines(spark, sf_dir), window["start"], window["end"])


OUT_OF_POCKET_SQL = f"""WITH {CLAIMS_SQL}, {LINES_SQL}, p AS (
  SELECT claim_id, sum(charged_cents - other_cents) AS open, bool_or(service_date BETWEEN DATE '1998-04-01' AND DATE '1999-03-31') AS touches FROM lines GROUP BY 1)
SELECT member_id, CAST(sum(greatest(0, open - CASE WHEN claim_id % 7 = 0 THEN 0 ELSE total_cents * 3 // 5 END)) AS BIGINT) AS out_of_pocket_cents
FROM claims JOIN p USING (claim_id) WHERE touches AND (claim_id % 7 = 0 OR status <> 'submitted') GROUP BY 1"""


#: A plan of shares alone, so that estimates of claims don't act on one another and SQL can say them.
GUIDE = fold.PlanRules(
    {i: fold.Benefit(fold.Coverage("percent", 80.0), waiting_months=24 if i == 3 else 0) for i in range(12)},
    period=fold.Period("benefit_year", start_month=4), effective=date(1994, 4, 30), submission_days=400, days_after_end=60, hospital=frozenset({5}),
)


def guide_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of every submitted claim under that plan, as of 1998."""
    c = claims(spark, sf_dir).withColumns({"family_id": div(F.col("member_id"), 4), "paid_cents": F.lit(None).cast("bigint")})
    lines = claim_lines(spark, sf_dir, numbered=True)
    return fold.quote_families(lines.join(c, "claim_id"), GUIDE, date(1998, 1, 1))


GUIDE_SQL = f"""{CLAIMS_SQL}, {LINES_SQL}, l AS (SELECT lines.*, charged_cents - least(charged_cents, other_cents) AS balance,
    CASE WHEN month(service_date) >= 4 THEN year(service_date) + 1 ELSE year(service_date) END AS y FROM lines JOIN claims USING (claim_id) WHERE status = 'submitted'),
d AS (SELECT *, greatest(service_date + 400, make_date(y, 3, 31) + 60) AS deadline, (2 * charged_cents * 80 + 100) // 200 AS raw,
  CASE WHEN benefit_id >= 12 THEN 'plan' WHEN service_date < DATE '1994-04-30' THEN 'date' WHEN benefit_id = 3 AND service_date < DATE '1996-04-30' THEN 'wait' END AS bar FROM l),
p AS (SELECT *, CASE WHEN bar IS NOT NULL THEN 0 ELSE least(raw, balance) END AS pays FROM d)"""


def claim_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members' figures for a year that began on April 1, 1998: paid, awaited and decided claims, drafts."""
    c, k = claims(spark, sf_dir), F.col("claim_id")
    last = claim_lines(spark, sf_dir).groupBy("claim_id").agg(F.max("service_date").alias("last_service"))
    paid = F.when(F.col("status") != "submitted", div(F.col("total_cents") * 3, 5))
    rows = c.join(last, "claim_id", "left").select("claim_id", "member_id", F.when((k % 9 == 0) & (F.col("status") != "submitted"), "draft").otherwise(F.col("status")).alias("status"), "last_service", F.when(k % 9 != 0, paid).alias("paid_cents"))
    return ledger.claim_kpis(rows, guide_quotes(spark, sf_dir), _D("1998-04-01"))


CLAIM_KPIS_SQL = f"""WITH {GUIDE_SQL}, q AS (SELECT claim_id, sum(pays) AS pays FROM p GROUP BY 1), s AS (SELECT claim_id, max(service_date) AS last FROM lines GROUP BY 1),
r AS (SELECT member_id, status = 'submitted' AS open, claim_id % 9 = 0 AND status <> 'submitted' AS draft, coalesce(last >= DATE '1998-04-01', false) AS own,
  CASE WHEN status <> 'submitted' AND claim_id % 9 <> 0 THEN total_cents * 3 // 5 END AS paid, coalesce(pays, 0) AS pays FROM claims LEFT JOIN s USING (claim_id) LEFT JOIN q USING (claim_id))
SELECT member_id, CAST(sum(CASE WHEN own THEN coalesce(paid, 0) ELSE 0 END) AS BIGINT) AS paid_cents, CAST(sum(CASE WHEN open THEN pays ELSE 0 END) AS BIGINT) AS awaiting_cents,
  CAST(count(*) FILTER (own AND paid IS NOT NULL) AS BIGINT) AS decided, CAST(count(*) FILTER (draft) AS BIGINT) AS drafts FROM r GROUP BY 1"""


def recent_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 25 paid claims with a line of benefit 3: a top-k report."""
    some = claim_lines(spark, sf_dir).where("benefit_id = 3").select("claim_id")
    c = claims(spark, sf_dir).where("status = 'paid'").join(some, "claim_id", "left_semi")
    return c.orderBy(F.desc("created"), "claim_id").limit(25).select("claim_id", "member_id", "created")


RECENT_CLAIMS_SQL = f"""WITH {CLAIMS_SQL}, {LINES_SQL} SELECT claim_id, member_id, created FROM claims WHERE status = 'paid'
  AND claim_id IN (SELECT claim_id FROM lines WHERE benefit_id = 3) ORDER BY created DESC, claim_id LIMIT 25"""

_YEAR = fold.Period("benefit_year", start_month=1)
RULES = fold.PlanRules(
    benefits={
        i: fold.Benefit(
            coverage=fold.Coverage("percent_capped", percent=80.0, cap=20_000_00) if i % 4 else fold.Coverage("fixed_per_service", amount=1_500_00),
            limits=(fold.Limit(LIMIT_CENTS, _YEAR),) + ((fold.Limit(60, fold.Period("rolling_months", months=24), unit="visits"),) if i % 5 == 0 else ()),
            shares=(fold.Share("deductible", "deductible", DEDUCTIBLE_CENTS, _YEAR),) if i % 2 else (),
            pool=f"P{i // 5}" if i < 10 else None,
            frequency=fold.Limit(80, fold.Period("consecutive_benefit_years", years=2), unit="services", scope="per_family") if i == 7 else None,
            waiting_months=12 if i == 11 else 0,
        )
        for i in range(BENEFITS)
    },
    pools={"P0": fold.Limit(POOL_CENTS, _YEAR, scope="per_family"), "P1": fold.Limit(POOL_CENTS, fold.Period("lifetime"))},
    effective=date(1994, 4, 30),
)


STATE_RULES = fold.PlanRules(
    benefits={
        i: fold.Benefit(
            coverage=fold.Coverage("percent", percent=80.0), limits=(fold.Limit(LIMIT_CENTS, _YEAR),), pool=f"P{i // 5}" if i < 10 else None,
            frequency=fold.Limit(60, fold.Period("consecutive_benefit_years", years=2), unit="services", scope="per_family") if i % 3 == 0 else None,
        )
        for i in range(BENEFITS)
    },
    pools={p: fold.Limit(POOL_CENTS, _YEAR, scope="per_family") for p in ("P0", "P1")},
    effective=date(1994, 4, 30),
)


def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family's ledger under limits of persons, pools of families and services in two years, which act on one another."""
    c = claims(spark, sf_dir).withColumns({"family_id": div(F.col("member_id"), 4), "paid_cents": F.lit(None).cast("bigint")})
    out = fold.replay_families(claim_lines(spark, sf_dir, numbered=True).join(c, "claim_id"), STATE_RULES)
    return out.select("claim_id", "line_id", "paid_cents", "limited_by")


# a line of each family a round; what is used of each rule and window is a list with a place for each
LEDGER_STATE_SQL = f"""WITH RECURSIVE {CLAIMS_SQL}, {LINES_SQL},
f AS (SELECT claim_id, min(service_date) AS first FROM lines GROUP BY 1),
o AS (SELECT member_id // 4 AS fam, claim_id, line_id, benefit_id, charged_cents AS charged, charged_cents - least(charged_cents, other_cents) AS balance, quantity, service_date >= DATE '1994-04-30' AS on_plan,
  row_number() OVER (PARTITION BY member_id // 4 ORDER BY first, created, claim_id, service_date, line_id) AS i,
  dense_rank() OVER (PARTITION BY member_id // 4 ORDER BY member_id, benefit_id, year(service_date)) AS kl,
  dense_rank() OVER (PARTITION BY member_id // 4 ORDER BY least(benefit_id // 5, 2), year(service_date)) AS kp,
  dense_rank() OVER (PARTITION BY member_id // 4 ORDER BY benefit_id, CAST(floor((year(service_date) - 1994) / 2.0) AS BIGINT)) AS kf
  FROM lines JOIN claims USING (claim_id) JOIN f USING (claim_id)),
r AS (SELECT fam, CAST(0 AS BIGINT) AS i, list_transform(range(max(kl)), lambda x: CAST(0 AS BIGINT)) AS l, list_transform(range(max(kp)), lambda x: CAST(0 AS BIGINT)) AS p,
    list_transform(range(max(kf)), lambda x: CAST(0 AS BIGINT)) AS s, CAST(NULL AS BIGINT) AS claim_id, CAST(NULL AS BIGINT) AS line_id, CAST(NULL AS BIGINT) AS pays, CAST(NULL AS VARCHAR) AS why FROM o GROUP BY fam
  UNION ALL SELECT fam, i, l[:kl - 1] || [l[kl] + pays] || l[kl + 1:], p[:kp - 1] || [p[kp] + pays] || p[kp + 1:], s[:kf - 1] || [s[kf] + CASE WHEN pays > 0 THEN greatest(1, quantity) ELSE 0 END] || s[kf + 1:],
    claim_id, line_id, pays, why FROM (
  SELECT *, CASE WHEN NOT on_plan THEN 0 WHEN benefit_id < 10 AND greatest(0, {POOL_CENTS} - p[kp]) < c THEN greatest(0, {POOL_CENTS} - p[kp]) ELSE c END AS pays,
    CASE WHEN NOT on_plan THEN 'not_covered' WHEN benefit_id < 10 AND greatest(0, {POOL_CENTS} - p[kp]) < c THEN 'pool' WHEN c = charged THEN NULL ELSE wc END AS why FROM (
  SELECT *, least(b, greatest(0, {LIMIT_CENTS} - l[kl])) AS c, CASE WHEN greatest(0, {LIMIT_CENTS} - l[kl]) < b THEN 'limit' ELSE wb END AS wc FROM (
  SELECT *, least(a, t) AS b, CASE WHEN t < a THEN 'frequency' ELSE wa END AS wb FROM (
  SELECT *, CASE WHEN benefit_id % 3 > 0 THEN a WHEN s[kf] >= 60 THEN 0 WHEN quantity > 60 - s[kf] THEN (2 * a * (60 - s[kf]) + quantity) // (2 * quantity) ELSE a END AS t FROM (
  SELECT r.l, r.p, r.s, o.*, least((2 * charged * 80 + 100) // 200, balance) AS a, CASE WHEN balance < charged AND balance < (2 * charged * 80 + 100) // 200 THEN 'other_plan' WHEN charged > (2 * charged * 80 + 100) // 200 THEN 'coverage' END AS wa
  FROM r JOIN o ON o.fam = r.fam AND o.i = r.i + 1))))))
SELECT claim_id, line_id, pays AS paid_cents, why AS limited_by FROM r WHERE i > 0"""


def ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole estimator over every family of four members, with recorded outcomes of decided claims."""
    c = claims(spark, sf_dir).withColumn("family_id", div(F.col("member_id"), 4))
    paid = F.when(F.col("status") != "submitted", div(F.col("total_cents") * 3, 5))
    lines = claim_lines(spark, sf_dir, numbered=True)
    return fold.replay_families(lines.join(c.withColumn("paid_cents", paid), "claim_id"), RULES)


QUERIES = {
    "period_windows": (period_windows, PERIOD_WINDOWS_SQL),
    "claim_deadlines": (claim_deadlines, CLAIM_DEADLINES_SQL),
    "counted_claims": (counted_claims, COUNTED_CLAIMS_SQL),
    "limit_usage": (limit_usage, LIMIT_USAGE_SQL),
    "pool_usage": (pool_usage, POOL_USAGE_SQL),
    "plan_bridges": (plan_bridges, PLAN_BRIDGES_SQL),
    "frequency_usage": (frequency_usage, FREQUENCY_USAGE_SQL),
    "deductible_running": (deductible_running, DEDUCTIBLE_SQL),
    "capped_reimbursement": (capped_reimbursement, CAPPED_SQL),
    "allocate_outcomes": (allocate_outcomes, ALLOCATE_SQL),
    "member_headline": (member_headline, HEADLINE_SQL),
    "out_of_pocket": (out_of_pocket, OUT_OF_POCKET_SQL),
    "claim_kpis": (claim_kpis, CLAIM_KPIS_SQL),
    "recent_claims": (recent_claims, RECENT_CLAIMS_SQL),
    "ledger_replay": (ledger_replay, None),
    "ledger_state": (ledger_state, LEDGER_STATE_SQL),
}
