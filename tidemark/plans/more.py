"""Queries over links by name, dense usage, quotes, step budgets, reports and ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assembly, conversation, evals, ingest, linking, ops, rules, usage
from ..sources.adapter import CLAIMS_SQL, LINES_SQL, claim_lines, claims, table
from .benefits import GUIDE_SQL, guide_quotes

KEYS = ["plan_id"]


def _benefits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct part names of a brand as its benefits, numbered by name; a keyword each."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("plan_id"), F.col("p_name").alias("name")).distinct()
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("name"))
    keywords = F.array(F.lit("unrelated words here"), F.concat(F.lit("zq"), F.md5(F.col("name").cast("binary"))))
    return p.select("plan_id", F.concat(F.lit("b"), place.cast("string")).alias("benefit_id"), place.alias("place"), "name", keywords.alias("keywords"))


def _turned() -> Column:
    """A name's words turned round."""
    return F.concat_ws(" ", F.upper(F.element_at(F.split("name", " "), 2)), F.element_at(F.split("name", " "), 1))


def _pool_rows(b: DataFrame) -> DataFrame:
    """Three pools a brand: of every third name by its words turned round, of every fifth by its keyword, and one without
    an amount; the first is read twice."""
    listed = lambda c, n: F.array_join(F.sort_array(F.collect_list(F.when(F.col("place") % n == 0, c))), "; ")
    per = b.groupBy("plan_id").agg(listed(_turned(), 3).alias("a"), listed(F.col("keywords")[1], 5).alias("b"))
    row = lambda i, name, unit, amount, names, c: F.struct(
        F.lit(i).alias("row_id"), F.lit(name).alias("pool_name"), F.lit(unit).cast("string").alias("unit"), F.lit(amount).cast("double").alias("amount"),
        names.alias("benefit_names"), F.lit(c).alias("confidence"), F.lit(i).alias("place"),
    )
    rows = F.array(
        row(1, "Combined A", "dollars", 1500.255, F.concat(F.col("a"), F.lit("\nqqqq zzzz xxxx")), 0.9), row(2, "Combined B", "visits", 20.5, F.col("b"), 0.8),
        row(3, "Empty", None, None, F.lit(""), 0.7), row(4, "combined  a", "dollars", 1.0, F.lit(""), 0.1),
    )
    return per.select("plan_id", F.explode(rows).alias("r")).select("plan_id", "r.*")


def pool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of each benefit, by the pools' lists and by the benefits' own word."""
    b = _benefits(spark, sf_dir)
    own = b.where("place % 7 = 0").select("plan_id", (F.col("place") + 100).alias("row_id"), _turned().alias("benefit_name"), F.lit("b COMBINED").alias("pool_name"))
    _, links, _ = linking.build_pools(_pool_rows(b), own, b, KEYS)
    return links


_BENEFITS_SQL = """b AS (SELECT plan_id, name, row_number() OVER (PARTITION BY plan_id ORDER BY name) AS place FROM (SELECT DISTINCT p_brand AS plan_id, p_name AS name FROM part))"""
POOL_LINKS_SQL = f"""WITH {_BENEFITS_SQL}
SELECT plan_id, 'b' || place AS benefit_id, CASE WHEN place % 3 = 0 THEN 'pool-combined-a' ELSE 'pool-combined-b' END AS pool_id FROM b WHERE place % 3 = 0 OR place % 5 = 0 OR place % 7 = 0"""


def pool_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools and issues by plan, counted."""
    b = _benefits(spark, sf_dir)
    own = b.where("place % 7 = 0").select("plan_id", (F.col("place") + 100).alias("row_id"), _turned().alias("benefit_name"), F.lit("no such pool zz").alias("pool_name"))
    pools, _, issues = linking.build_pools(_pool_rows(b), own, b, KEYS)
    a = issues.groupBy("plan_id", "code", "severity").agg(F.count("*").alias("n"))
    return a.unionByName(pools.select("plan_id", F.col("pool_id").alias("code"), F.col("unit").alias("severity"), F.col("value").alias("n")))


POOL_ISSUES_SQL = f"""WITH {_BENEFITS_SQL}, p AS (SELECT DISTINCT plan_id FROM b)
SELECT plan_id, 'field_missing' AS code, 'warning' AS severity, 1::BIGINT AS n FROM p
UNION ALL SELECT plan_id, 'unlinked_pool', 'warning', 1 + count(*) FILTER (place % 7 = 0) FROM b GROUP BY 1
UNION ALL SELECT plan_id, 'unlinked_pool', 'info', count(*) FROM b WHERE place % 15 = 0 GROUP BY 1
UNION ALL SELECT plan_id, 'pool-combined-a', 'cents', 150026 FROM p UNION ALL SELECT plan_id, 'pool-combined-b', 'visits', 20 FROM p"""


def share_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of cost shares: categories by name or kind before benefits, and what is not found."""
    b = _benefits(spark, sf_dir)
    c = table(spark, sf_dir, "part").select(F.col("p_brand").alias("plan_id"), F.lower("p_type").alias("kind")).distinct()
    c = c.select("plan_id", F.concat(F.lit("c-"), "kind").alias("category_id"), F.ascii("kind").alias("place"), F.concat("kind", F.lit(" parts and things")).alias("name"), F.concat("kind", F.lit("_care")).alias("kind"))
    row = lambda i, name, to, sure: F.struct(F.lit(i).alias("row_id"), F.lit(name).alias("name"), to.alias("applies_to"), F.lit(sure).alias("confidence"), F.lit(i).alias("place"))
    first = b.where("place = 1").select("plan_id", _turned().alias("turned"))
    rows = F.array(
        row(1, "Deductible", F.concat(F.lit("promo care, parts and things LARGE; nothing like it qz, "), F.col("turned")), 0.9),
        row(2, "Excess", F.lit(None).cast("string"), 0.5), row(3, "deductible ", F.lit("promo care"), 0.2),
    )
    r = first.select("plan_id", F.explode(rows).alias("r")).select("plan_id", "r.*")
    links, issues = linking.share_targets(r, c, b, KEYS)
    told = issues.select("plan_id", F.concat_ws(":", "code", "severity").alias("share_id"), F.lit(None).cast("string").alias("category_id"), F.col("row_id").cast("string").alias("benefit_id"))
    return links.unionByName(told)


SHARE_LINKS_SQL = """WITH t AS (SELECT DISTINCT p_brand AS plan_id, lower(p_type) AS kind FROM part), p AS (SELECT DISTINCT plan_id FROM t)
SELECT plan_id, 'cs-deductible' AS share_id, 'c-' || kind AS category_id, CAST(NULL AS VARCHAR) AS benefit_id FROM t WHERE kind IN ('promo', 'large')
UNION ALL SELECT plan_id, 'cs-deductible', NULL, 'b1' FROM p
UNION ALL SELECT plan_id, 'unlinked_cost_share:warning', NULL, '1' FROM p UNION ALL SELECT plan_id, 'unlinked_cost_share:info', NULL, '2' FROM p
UNION ALL SELECT plan_id, 'unlinked_cost_share:warning', NULL, '1' FROM p WHERE plan_id NOT IN (SELECT plan_id FROM t WHERE kind = 'promo')
UNION ALL SELECT plan_id, 'unlinked_cost_share:warning', NULL, '1' FROM p WHERE plan_id NOT IN (SELECT plan_id FROM t WHERE kind = 'large')"""

PLANS = 7


def _usage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    plan = F.col("member_id") % PLANS
    members = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % PLANS).alias("plan_id"), F.col("c_custkey").alias("member_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.date_add(F.lit("1998-01-31").cast("date"), (F.col("c_custkey") % 300).cast("int"))).alias("coverage_start"),
    )
    b = spark.range(PLANS).select(F.col("id").alias("plan_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("benefit_id"))
    b = b.withColumns(
        {"limit_cents": F.when(F.col("benefit_id") % 3 != 0, F.lit(9_000_000).cast("bigint")), "waiting_months": (F.col("benefit_id") % 4 * 3).cast("int"),
         "effective": F.lit("1998-05-31").cast("date"), "frequency": F.when(F.col("benefit_id") == F.col("plan_id"), 2)}
    )
    c = claims(spark, sf_dir).withColumn("plan_id", plan)
    c = usage.without_claim(c, F.col("member_id") % PLANS, F.lit(7).cast("bigint"))
    lines = claim_lines(spark, sf_dir).where("benefit_id < 6").join(c.select("claim_id", "plan_id", "member_id"), "claim_id")
    used = lines.groupBy("plan_id", "member_id", "benefit_id").agg(F.sum("charged_cents").alias("used_cents"))
    return usage.dense_usage(members, b, used, F.lit("1998-12-31").cast("date")), b


def plan_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member with every benefit of the plan; claim 7 is left out."""
    return _usage(spark, sf_dir)[0]


_USAGE_SQL = f"""{CLAIMS_SQL}, {LINES_SQL}, m AS (SELECT c_custkey AS member_id, c_custkey % {PLANS} AS plan_id,
  CASE WHEN c_custkey % 2 = 0 THEN DATE '1998-01-31' + CAST(c_custkey % 300 AS INTEGER) END AS start FROM customer),
u AS (SELECT member_id, benefit_id, CAST(sum(charged_cents) AS BIGINT) AS used FROM lines JOIN claims USING (claim_id) WHERE claim_id <> 7 AND benefit_id < 6 GROUP BY 1, 2),
d AS (SELECT plan_id, m.member_id, b.benefit_id, coalesce(used, 0) AS used_cents, CASE WHEN b.benefit_id % 3 <> 0 THEN greatest(0, 9000000 - coalesce(used, 0)) END AS remaining_cents,
  CASE WHEN b.benefit_id % 4 > 0 THEN CAST(coalesce(start, DATE '1998-05-31') + to_months(CAST(b.benefit_id % 4 * 3 AS INTEGER)) AS DATE) END AS waiting_ends
  FROM m CROSS JOIN (SELECT unnest(generate_series(0::BIGINT, 5::BIGINT)) AS benefit_id) b LEFT JOIN u ON u.member_id = m.member_id AND u.benefit_id = b.benefit_id),
w AS (SELECT *, coalesce(DATE '1998-12-31' < waiting_ends, false) AS waiting FROM d)"""
PLAN_USAGE_SQL = f"WITH {_USAGE_SQL} SELECT * FROM w"


def headline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What members' headlines are made of, over used benefits and over all that wait for nothing."""
    rows = _usage(spark, sf_dir)[0]
    per = [
        usage.shown(rows, every).groupBy("plan_id", "member_id", F.lit(every).alias("every")).agg(F.count("*").alias("n"), F.sum("remaining_cents").alias("remaining_cents"))
        for every in (False, True)
    ]
    return per[0].unionByName(per[1])


HEADLINE_ROWS_SQL = f"""WITH {_USAGE_SQL}
SELECT plan_id, member_id, false AS every, count(*) AS n, CAST(sum(remaining_cents) AS BIGINT) AS remaining_cents FROM w WHERE used_cents > 0 GROUP BY 1, 2
UNION ALL SELECT plan_id, member_id, true, count(*), CAST(sum(remaining_cents) AS BIGINT) FROM w WHERE NOT waiting GROUP BY 1, 2"""


def schedule_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, b = _usage(spark, sf_dir)
    return usage.schedule_lists(rows, b).groupBy("plan_id", "benefit_id", "list").agg(F.count("*").alias("n"))


SCHEDULE_LISTS_SQL = f"""WITH {_USAGE_SQL} SELECT plan_id, benefit_id, 'frequency' AS list, count(*) AS n FROM w WHERE benefit_id = plan_id GROUP BY 1, 2
UNION ALL SELECT plan_id, benefit_id, CASE WHEN waiting THEN 'waiting' ELSE 'served' END, count(*) FROM w WHERE benefit_id % 4 > 0 GROUP BY ALL"""

def claim_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of submitted claims under a plan of shares alone: who pays what, by when to claim, warnings."""
    return guide_quotes(spark, sf_dir).drop("limit_left", "pool_left")


CLAIM_QUOTES_SQL = f"""WITH {GUIDE_SQL}
SELECT claim_id, line_id, CAST(pays AS BIGINT) AS pays, CAST(balance - pays AS BIGINT) AS member_pays,
  CASE WHEN bar = 'wait' THEN 'waiting_period' WHEN bar IS NOT NULL THEN 'not_covered' WHEN pays = charged_cents THEN NULL WHEN balance < raw THEN 'other_plan' ELSE 'coverage' END AS limited_by,
  deadline, CASE bar WHEN 'plan' THEN 'not_in_plan' WHEN 'date' THEN 'before_coverage' ELSE concat_ws(',', CASE WHEN bar = 'wait' THEN 'waiting_until' END,
    CASE WHEN deadline < DATE '1998-01-01' THEN 'deadline_passed' END, CASE WHEN benefit_id = 5 THEN 'guide_only' END) END AS warnings FROM p"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages: of the assistant a text and a call of a tool, whose state goes by the text's length."""
    t, n = table(spark, sf_dir, "conversations"), F.length("text")
    states = ["output-available", "output-denied", "input-streaming", "output-error", "approval-responded", "approval-requested"]
    state = F.element_at(F.array(*[F.lit(s) for s in states]), (n % 6 + 1).cast("int"))
    text = F.to_json(F.struct(F.lit("text").alias("type"), F.when(n % 10 == 9, " ").otherwise(F.md5(F.col("text").cast("binary"))).alias("text")))
    call = F.to_json(
        F.struct(
            F.concat(F.lit("tool-t"), (n % 3).cast("string")).alias("type"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("toolCallId"), state.alias("state"),
            F.struct((n % 2).alias("b"), F.lit(1).alias("a")).alias("input"), F.when(n % 6 == 0, F.struct((n % 4).alias("nestedToolCalls"))).alias("output"),
            F.struct((n % 12 == 10).alias("approved")).alias("approval"),
        )
    )
    parts = F.concat(F.lit("["), text, F.when(F.col("role") == "assistant", F.concat(F.lit(","), call)).otherwise(""), F.lit("]"))
    return t.select("conv_id", "turn", "role", parts.alias("parts"), (n % 13 == 5).alias("blocked"))


def replayed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.replay_items(_messages(spark, sf_dir))


def step_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps used in the current turn, against two."""
    out = conversation.step_budget(replayed_items(spark, sf_dir), table(spark, sf_dir, "conversations"), 2)
    return out.withColumn("declined", F.array_join("declined", "|"))


_ITEMS_SQL = """u AS (SELECT conv_id, turn, role, text, length(text) AS n, role = 'assistant' AND length(text) % 13 = 5 AS bad,
  max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last_user FROM conversations WHERE role IN ('user', 'assistant')),
k AS (SELECT *, coalesce(lead(bad) OVER (PARTITION BY conv_id ORDER BY turn), false) AS next_bad FROM u),
m AS (SELECT *, n % 6 = 1 OR (n % 6 = 4 AND n % 12 <> 10) AS no, 't' || n % 3 AS tool, '{"a":1,"b":' || n % 2 || '}' AS args FROM k WHERE NOT bad AND NOT (role = 'user' AND next_bad)),
i AS (SELECT conv_id, turn, 0 AS p, role, 'message' AS type, NULL AS call_id, NULL AS name, md5(text) AS content, 0 AS steps, NULL AS declined, turn > coalesce(last_user, -1) AS now FROM m WHERE n % 10 <> 9
  UNION ALL SELECT conv_id, turn, 1, role, 'function_call', 'c' || turn, tool, args, CASE WHEN n % 6 = 0 THEN 1 + n % 4 ELSE 1 END, CASE WHEN no THEN tool || ':' || args END, turn > coalesce(last_user, -1) FROM m WHERE role = 'assistant' AND n % 6 <> 2
  UNION ALL SELECT conv_id, turn, 2, role, 'function_call_output', 'c' || turn, NULL, CASE WHEN no THEN '{"declined":true,"reason":null}' WHEN n % 6 = 0 THEN '{"nestedToolCalls":' || n % 4 || '}'
    WHEN n % 6 = 3 THEN '{"error":"The tool failed."}' WHEN n % 6 = 5 THEN '{"declined":true,"reason":"The user did not respond to the approval request."}'
    ELSE '{"error":"not_executed","message":"The tool did not run."}' END, 0, NULL, turn > coalesce(last_user, -1) FROM m WHERE role = 'assistant' AND n % 6 <> 2)"""
REPLAYED_SQL = f"""WITH {_ITEMS_SQL} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) AS item, role, type, call_id, name, content, CAST(steps AS INTEGER) AS steps, declined,
  now AS in_current_turn FROM i"""
STEP_BUDGET_SQL = f"""WITH {_ITEMS_SQL}, s AS (SELECT conv_id, sum(CASE WHEN now THEN steps ELSE 0 END) AS used,
  coalesce(array_to_string(list_sort(list_distinct(list(declined) FILTER (now AND declined IS NOT NULL))), '|'), '') AS declined FROM i GROUP BY 1),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, CAST(coalesce(used, 0) AS BIGINT) AS steps_used, CAST(greatest(0, 2 - coalesce(used, 0)) AS BIGINT) AS steps_left, coalesce(declined, '') AS declined FROM c LEFT JOIN s USING (conv_id)"""


def tool_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    executor = F.when(F.col("user_id") % 2 == 0, "server").otherwise("browser")
    outcome = F.when(F.col("event_id") % 7 == 0, "error").when(F.col("event_id") % 11 == 0, "rejected").otherwise("ok")
    calls = e.select(F.col("event_type").alias("tool"), executor.alias("executor"), outcome.alias("outcome"), F.lit(1).cast("bigint").alias("n"))
    timed = e.where("event_type <> 'view'").select(F.col("event_type").alias("tool"), executor.alias("executor"), (F.col("event_id") % 4).alias("n"), F.col("cents").alias("total_ms"))
    return ops.tool_report(calls, timed)


TOOL_REPORT_SQL = """WITH e AS (SELECT event_type AS tool, CASE WHEN user_id % 2 = 0 THEN 'server' ELSE 'browser' END AS executor, event_id, CAST(round(value * 100) AS BIGINT) AS ms FROM events),
c AS (SELECT tool, executor, count(*) AS calls, count(*) FILTER (event_id % 7 = 0 OR event_id % 11 = 0) AS errors FROM e GROUP BY 1, 2),
d AS (SELECT tool, executor, ms / (event_id % 4) AS v, event_id % 4 AS n FROM e WHERE tool <> 'view' AND event_id % 4 > 0),
r AS (SELECT *, sum(n) OVER (PARTITION BY tool, executor ORDER BY v) AS run, sum(n) OVER (PARTITION BY tool, executor) AS every FROM d),
p AS (SELECT tool, executor, round(min(v), 0) AS p95_ms FROM r WHERE run >= every * 0.95 GROUP BY 1, 2)
SELECT tool, executor, calls, CAST(errors AS BIGINT) AS errors, round(100.0::DOUBLE * errors / calls, 1) AS error_rate_pct, p95_ms FROM c LEFT JOIN p USING (tool, executor)"""


def budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of events on its own, against budgets of which one is nearly met."""
    e = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    spend = e.select(F.col("event_type").alias("namespace"), F.lit("2024-01-10 00:00:00").cast("timestamp").alias("ts"), F.col("cents").alias("amount"))
    other = e.select(F.lit("click").alias("namespace"), "ts", F.col("cents").alias("amount")).where(F.to_date("ts") != F.lit("2024-01-10"))
    budgets = spark.createDataFrame([("click", 1_000), ("view", 10**12), ("purchase", 30_000), ("none", 1)], "namespace string, budget bigint")
    return ops.budget_alerts(spend.unionByName(other), budgets, F.lit("2024-01-10").cast("date"))


BUDGET_ALERTS_SQL = """WITH s AS (SELECT event_type AS namespace, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS spent FROM events GROUP BY 1),
b(namespace, budget) AS (VALUES ('click', 1000::BIGINT), ('view', 1000000000000::BIGINT), ('purchase', 30000::BIGINT), ('none', 1::BIGINT)),
u AS (SELECT namespace, spent, budget, round(100.0::DOUBLE * spent / budget, 1) AS used_pct FROM s JOIN b USING (namespace))
SELECT * FROM u WHERE used_pct >= 80"""


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    section = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, "")
    text = ingest.embedding_text(F.col("source"), section, F.col("text"))
    return d.select("doc_id", F.md5(text.cast("binary")).alias("hash"))


EMBEDDING_SQL = "SELECT doc_id, md5(source || CASE WHEN doc_id % 3 = 0 THEN ' — ' || lang ELSE '' END || chr(10) || chr(10) || text) AS hash FROM documents"


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks merged into an index that lacks some, and holds others that are no more."""
    d = table(spark, sf_dir, "documents").withColumn("section", F.col("lang"))
    chunks = ingest.with_hashes(d).select("id", "source", "section", "text", "content_hash", "doc_id")
    stored = chunks.where("doc_id % 3 <> 0").dropDuplicates(["id"]).withColumn("fetched", F.lit("old"))
    _, report = ingest.apply_batch(stored, chunks.where("doc_id % 5 <> 0").drop("doc_id").withColumn("doc_id", F.lit(0).cast("bigint")), F.lit("new"))
    return report


BATCH_SQL = """WITH d AS (SELECT doc_id, source, source || '-' || substr(sha256(lang || chr(10) || text), 1, 20) AS id FROM documents),
s AS (SELECT DISTINCT source, id FROM d WHERE doc_id % 3 <> 0), n AS (SELECT DISTINCT source, id FROM d WHERE doc_id % 5 <> 0),
j AS (SELECT coalesce(n.source, s.source) AS source, CASE WHEN s.id IS NULL THEN 'u' WHEN n.id IS NULL THEN 'd' ELSE 't' END AS k FROM n FULL JOIN s ON n.id = s.id)
SELECT source, count(*) FILTER (k = 'u') AS uploaded, count(*) FILTER (k = 't') AS touched, count(*) FILTER (k = 'd') AS deleted,
  CASE WHEN count(*) FILTER (k <> 't') > 0 THEN 'changed' ELSE 'unchanged' END AS status FROM j WHERE source IN (SELECT source FROM n) GROUP BY 1"""


def citation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    passed = F.when(F.col("n_chars") % 4 != 0, F.col("n_chars") % 3 == 0)
    return evals.citation_rates(d.select("lang", passed.alias("passed"), (F.col("doc_id") % 2 == 0).alias("expected_hit")), ["lang"])


CITATION_RATES_SQL = """SELECT lang, count(*) AS rows, count(*) FILTER (n_chars % 4 <> 0 AND n_chars % 3 = 0) / count(*) AS pass_rate,
  count(*) FILTER (doc_id % 2 = 0) / count(*) AS expected_rate FROM documents GROUP BY 1"""


def rows_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of pages, with verdicts for some of them, the second of two counting, and pages missing."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = d.select(n.alias("row_id"), (n % 9).alias("page"), (F.col("n_chars") % 101).alias("score"))
    words = lambda k: F.element_at(F.array(*[F.lit(w) for w in ("supported", "corrected", "unsupported")]), ((n + k) % 3 + 1).cast("int"))
    first = d.where("doc_id % 2 = 0").select(n.alias("row_id"), words(0).alias("verdict"), F.lit(0).alias("place"))
    second = d.where("doc_id % 4 = 0").select(n.alias("row_id"), words(1).alias("verdict"), F.lit(1).alias("place"))
    pages = spark.range(1, 9).select(F.col("id").alias("page"))
    out, issues = assembly.judge_rows(rows, first.unionByName(second), pages, F.col("row_id") % 5 == 0)
    told = issues.groupBy("row_id", "page").agg(F.max("code").alias("code"), F.max("severity").alias("severity"))
    return told.join(out.select("row_id", "verdict", "grounded", "confidence"), "row_id", "left")


ROWS_JUDGED_SQL = """WITH r AS (SELECT doc_id AS row_id, doc_id % 9 AS page, n_chars % 101 AS s, doc_id % 9 > 0 AS known,
  CASE WHEN doc_id % 4 = 0 THEN ['supported', 'corrected', 'unsupported'][(doc_id + 1) % 3 + 1] WHEN doc_id % 2 = 0 THEN ['supported', 'corrected', 'unsupported'][doc_id % 3 + 1] END AS verdict FROM documents),
f AS (SELECT *, s >= 85 AS grounded, s * CASE verdict WHEN 'supported' THEN 1.0 WHEN 'corrected' THEN 0.85 WHEN 'unsupported' THEN 0.35 ELSE 0.75 END * 0.01 AS c FROM r),
g AS (SELECT *, CASE WHEN grounded THEN c ELSE least(c, 0.5) END * CASE WHEN row_id % 5 = 0 THEN 0.9 ELSE 1.0 END AS raw FROM f),
h AS (SELECT *, CAST(round(raw, 3) AS DOUBLE) AS confidence FROM g),
i AS (SELECT *, CASE WHEN NOT known OR verdict = 'unsupported' THEN 'unsupported_row' WHEN NOT grounded THEN 'ungrounded_quote' WHEN confidence < 0.6 THEN 'low_confidence' END AS code FROM h)
SELECT row_id, page, code, CASE WHEN code = 'low_confidence' THEN 'info' ELSE 'warning' END AS severity, CASE WHEN known THEN verdict END AS verdict, CASE WHEN known THEN grounded END AS grounded,
  CASE WHEN known THEN confidence END AS confidence FROM i WHERE code IS NOT NULL"""


def citations_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as answers to their own text: cited well, wrongly in one way each, and not at all."""
    b, n = table(spark, sf_dir, "benchmark"), F.col("item_id")
    words = F.regexp_replace(F.translate("text", '"“”', ""), r"\s+", " ")
    sources = spark.createDataFrame(
        [("a", "https://x/a/", True, "CC BY", True), ("b", "https://x/b", True, "Crown", False), ("c", "https://x/c", False, "CC  BY", True)],
        "source_id string, url string, index boolean, licence string, verbatim boolean",
    )
    answers = b.select(
        n.alias("id"), F.concat(F.lit('It says "'), F.when(n % 8 == 6, F.upper(words)).otherwise(words), F.lit('" there.')).alias("response"),
        F.when(n % 8 == 5, " ").otherwise(words).alias("context"), F.array(F.lit("a"), F.lit("zz")).alias("expected"),
    )
    ways = [("https://x/a#p", "CC  BY", "by a"), ("b-17", None, "by b"), ("c", "CC BY", "by c"), ("nowhere", "CC BY", "by"), ("a", "GPL", "by a"), ("b", "Crown", " "), ("a", None, "by a")]
    way = F.array(*[F.struct(F.lit(r).alias("ref"), F.lit(x).cast("string").alias("licence"), F.lit(t).alias("attribution")) for r, x, t in ways])
    cited = b.where("item_id % 8 < 7").select(n.alias("id"), F.element_at(way, (n % 8 + 1).cast("int")).alias("w")).select("id", "w.*")
    return evals.judge_citations(answers, cited, sources)


CITATIONS_JUDGED_SQL = """WITH b AS (SELECT item_id AS id, item_id % 8 AS k, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) > 50 AS long FROM benchmark)
SELECT id, CASE WHEN k < 7 THEN 1 ELSE 0 END::BIGINT AS citations, (k = 3)::BIGINT AS unknown, (k = 2)::BIGINT AS link_only, (k = 4)::BIGINT AS licence, (k = 5)::BIGINT AS attribution,
  k = 1 AND long AS overrun, CASE WHEN k = 6 THEN 1 ELSE 0 END AS altered, k IN (0, 4, 6) AS expected_hit, k = 0 OR (k = 1 AND NOT long) AS passed FROM b"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["DateOfBirth", "Person", "CreditCardNumber", "CABankAccountNumber", "Email"]
    category = F.element_at(F.array(*[F.lit(c) for c in names]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("lang", (F.col("n_chars") % 7).alias("page"), category.alias("category"), ((F.col("n_chars") % 101) / 100).alias("confidence"))


def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by tier and category, and pages with an advisory one."""
    hits = _hits(spark, sf_dir)
    a = rules.tier_counts(hits, ["lang"])
    b = rules.advisories(hits, ["lang"]).groupBy("lang", F.lit("pages").alias("tier"), "category").agg(F.count("*").alias("n"))
    return a.unionByName(b)


TIER_COUNTS_SQL = """WITH h AS (SELECT lang, n_chars % 7 AS page, ['DateOfBirth', 'Person', 'CreditCardNumber', 'CABankAccountNumber', 'Email'][doc_id % 5 + 1] AS category, n_chars % 101 AS p FROM documents),
t AS (SELECT *, CASE WHEN category IN ('DateOfBirth', 'CABankAccountNumber') AND p >= 80 THEN 'hard' WHEN category <> 'CreditCardNumber' AND p >= 50 THEN 'advisory' END AS tier FROM h)
SELECT lang, tier, category, count(*) AS n FROM t WHERE tier IS NOT NULL GROUP BY ALL
UNION ALL SELECT lang, 'pages', category, count(DISTINCT page) FROM t WHERE tier = 'advisory' GROUP BY 1, 3"""


def duplicate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text in a language, by the page they are on."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 13).alias("page"), F.md5(F.col("text").cast("binary")).alias("h"))
    kept = d.select("doc_id", F.min("doc_id").over(Window.partitionBy("lang", "h")).alias("kept_by"))
    return assembly.duplicate_issues(d, kept, "doc_id", "page")


DUPLICATES_SQL = """WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, md5(text)) AS k FROM documents)
SELECT doc_id % 13 AS page, count(*) AS removed, 'duplicate_removed' AS code, 'info' AS severity FROM k WHERE k <> doc_id GROUP BY 1"""


def digits_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits that print mistakes for letters, blanks as nulls, and snippets."""
    d = table(spark, sf_dir, "documents")
    raw = F.translate(F.concat(F.col("doc_id").cast("string"), F.lit("0152"), F.col("n_chars").cast("string")), "0125", "OlZS")
    return d.select(
        "doc_id", X.fold_digits(raw).alias("folded"), X.parse_blank(F.when(F.col("doc_id") % 2 == 0, "  ").otherwise(F.col("lang"))).alias("lang"),
        F.md5(X.snippet(F.col("text"), 60).cast("binary")).alias("snippet"),
    )


DIGITS_SQL = r"""WITH d AS (SELECT doc_id, lang, n_chars, trim(regexp_replace(text, '[ \t\n\f\r\x0B]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, doc_id || '0152' || n_chars AS folded, CASE WHEN doc_id % 2 = 1 THEN lang END AS lang,
  md5(CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 59)) || '…' ELSE t END) AS snippet FROM d"""


QUERIES = {
    "pool_links": (pool_links, POOL_LINKS_SQL),
    "pool_issues": (pool_issues, POOL_ISSUES_SQL),
    "share_links": (share_links, SHARE_LINKS_SQL),
    "plan_usage": (plan_usage, PLAN_USAGE_SQL),
    "headline_rows": (headline_rows, HEADLINE_ROWS_SQL),
    "schedule_lists": (schedule_lists, SCHEDULE_LISTS_SQL),
    "claim_quotes": (claim_quotes, CLAIM_QUOTES_SQL),
    "replayed_items": (replayed_items, REPLAYED_SQL),
    "step_budget": (step_budget, STEP_BUDGET_SQL),
    "tool_report": (tool_report, TOOL_REPORT_SQL),
    "budget_alerts": (budget_alerts, BUDGET_ALERTS_SQL),
    "embedding_texts": (embedding_texts, EMBEDDING_SQL),
    "batch_report": (batch_report, BATCH_SQL),
    "rows_judged": (rows_judged, ROWS_JUDGED_SQL),
    "citations_judged": (citations_judged, CITATIONS_JUDGED_SQL),
    "citation_rates": (citation_rates, CITATION_RATES_SQL),
    "tier_counts": (tier_counts, TIER_COUNTS_SQL),
    "duplicate_issues": (duplicate_issues, DUPLICATES_SQL),
    "digits_folded": (digits_folded, DIGITS_SQL),
}
