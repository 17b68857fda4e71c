"""Queries over events, labels and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, conversation, evals, ops
from ..sources.adapter import table
from ..streaming import guards

CENTS = "CAST(round(value * 100) AS BIGINT)"
TYPES = ["click", "error", "purchase", "signup", "view"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns({"cents": F.round(F.col("value") * 100).cast("bigint"), "k": F.get_json_object("props", "$.k").cast("bigint")})


def metric_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bins(events(spark, sf_dir), "1 hour", ["event_type"], F.col("cents"))


BINS_SQL = f"SELECT event_type, date_trunc('hour', ts) AS bin, count(*) AS n, CAST(sum({CENTS}) AS BIGINT) AS total FROM events GROUP BY 1, 2"


def weighted_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("weight", F.col("k") + 1)
    return ops.weighted_percentile(df, ["event_type"], "cents", "weight", 0.95).withColumnRenamed("cents", "p95_cents")


P95_SQL = f"""WITH e AS (SELECT event_type, {CENTS} AS cents, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS w FROM events),
r AS (SELECT event_type, cents, sum(w) OVER (PARTITION BY event_type ORDER BY cents) AS run, sum(w) OVER (PARTITION BY event_type) AS total FROM e)
SELECT event_type, min(cents) AS p95_cents FROM r WHERE run >= total * 0.95 GROUP BY 1"""


def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pivot(events(spark, sf_dir), F.to_date("ts").alias("day"), "event_type", TYPES, F.col("cents"))


_PIVOT = ", ".join(f"CAST(coalesce(sum({CENTS}) FILTER (event_type = '{t}'), 0) AS BIGINT) AS {t}" for t in TYPES)
PIVOT_SQL = f"SELECT CAST(ts AS DATE) AS day, {_PIVOT} FROM events GROUP BY 1"


def top_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten users who cost most, with their errors: a top-k report."""
    per = events(spark, sf_dir).groupBy("user_id").agg(
        F.sum("cents").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n")
    )
    return per.orderBy(F.desc("total"), "user_id").limit(10)


TOP_SQL = f"""SELECT user_id, CAST(sum({CENTS}) AS BIGINT) AS total, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, count(*) AS n
FROM events GROUP BY 1 ORDER BY total DESC, user_id LIMIT 10"""


def error_rate_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.error_alerts(events(spark, sf_dir), "15 minutes", [], F.col("event_type") == "error", 3, 0.4)


ALERT_SQL = """SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS bin, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors
FROM events GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (event_type = 'error') > 0.4 * count(*)"""


def daily_spend_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = ops.spend_gate(events(spark, sf_dir), "event_type", F.col("cents"), 100_000)
    return gated.select("event_id", "day", "cents", "spent", "allowed")


GATE_SQL = f"""WITH e AS (SELECT event_id, ts, event_type, CAST(ts AS DATE) AS day, {CENTS} AS cents FROM events),
s AS (SELECT *, coalesce(sum(cents) OVER (PARTITION BY event_type, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM e)
SELECT event_id, day, cents, CAST(spent AS BIGINT) AS spent, spent < 100000 AS allowed FROM s"""


def budget_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By type what is left of a month's budget; types without a row keep all of it (a right outer join)."""
    spent = events(spark, sf_dir).groupBy("event_type").agg(F.sum("cents").alias("spent"))
    budgets = spark.createDataFrame([("error", 5_000_000), ("view", 20_000_000), ("evals", 500)], "event_type string, budget bigint")
    joined = spent.join(budgets, "event_type", "right").withColumn("spent", F.coalesce("spent", F.lit(0).cast("bigint")))
    return joined.select("event_type", "spent", "budget", ops.remaining_percent(F.col("spent"), F.col("budget")).alias("left_pct"))


BUDGET_SQL = f"""WITH s AS (SELECT event_type, CAST(sum({CENTS}) AS BIGINT) AS spent FROM events GROUP BY 1),
b(event_type, budget) AS (VALUES ('error', 5000000::BIGINT), ('view', 20000000::BIGINT), ('evals', 500::BIGINT))
SELECT event_type, coalesce(spent, 0) AS spent, budget,
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, round(100.0::DOUBLE * (budget - coalesce(spent, 0)) / budget, 2))) AS left_pct FROM s RIGHT JOIN b USING (event_type)"""


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's calls of models, known and not, pages and records, in dollars."""
    model = F.when(F.col("event_type") == "view", "gpt-5-nano").when(F.col("event_type") == "click", "text-embedding-3-small").when(F.col("event_type") == "error", "gpt-5-mini").otherwise("other")
    df = events(spark, sf_dir).withColumn("micro", ops.token_cost(model, F.col("k") * 101, F.col("k") * 13))
    n = lambda i: F.count_if(F.col("event_id") % 4 == i)
    per = df.groupBy("user_id").agg(F.sum("micro").alias("micro"), *[n(i).alias(f"n{i}") for i in range(4)])
    return per.select("user_id", ops.usage_cost(F.col("micro"), *[F.col(f"n{i}") for i in range(4)]).alias("dollars"))


COST_SQL = """WITH e AS (SELECT user_id, event_type, event_id % 4 AS m, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT user_id, CAST(round((sum(CASE event_type WHEN 'view' THEN k * 101 * 0.05 + k * 13 * 0.40 WHEN 'click' THEN k * 101 * 0.02 ELSE k * 101 * 0.25 + k * 13 * 2.00 END)
  + 5000 * count(*) FILTER (m < 2) + 1000 * count(*) FILTER (m = 2) + 750 * count(*) FILTER (m = 3)) / 1000000.0, 6) AS DOUBLE) AS dollars FROM e GROUP BY 1"""


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.rate_limit(events(spark, sf_dir), "user_id", "ts", "event_id", most=3, seconds=6 * 3600)


RATE_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, n, true AS allowed, CAST(NULL AS BIGINT) AS retry_after, [t] AS hits FROM e WHERE n = 1
  UNION ALL SELECT event_id, user_id, n, ok, CASE WHEN NOT ok THEN CAST(ceil(wait / 1e6) AS BIGINT) END, CASE WHEN ok THEN list_append(hits, t)[-3:] ELSE hits END FROM (
    SELECT e.*, r.hits, len(r.hits) < 3 OR r.hits[1] + 21600000000 - e.t <= 0 AS ok, r.hits[1] + 21600000000 - e.t AS wait FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) x)
SELECT event_id, user_id, allowed, retry_after FROM r"""


def status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("k") % len(CODES) + 1).cast("int"))
    return events(spark, sf_dir).groupBy(ops.status_of(codes).alias("status")).agg(F.count("*").alias("n"))


CODES = [
    "invalid_request", "pii_detected", "unsafe_image", "content_filtered", "prompt_injection", "payload_too_large", "page_cap_exceeded",
    "unsupported_media_type", "rate_limited", "budget_exhausted", "booklet_cap_exceeded", "ai_disabled", "upstream_error", "internal_error", "other",
]
STATUS_SQL = """SELECT CAST([400, 422, 422, 422, 422, 413, 413, 415, 429, 429, 429, 503, 502, 500, 500][CAST(json_extract(props, '$.k') AS BIGINT) % 15 + 1] AS INTEGER) AS status,
  count(*) AS n FROM events GROUP BY 1"""


def claim_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's consecutive orders, with statuses by their numbers, which changes of status a claim could make."""
    from pyspark.sql import Window

    from ..sources.adapter import claims

    w = Window.partitionBy("member_id").orderBy("created", "claim_id")
    status = F.element_at(F.array(*[F.lit(x) for x in (*ops.TRANSITIONS, "lost")]), (F.col("claim_id") * 7 % 6 + 1).cast("int"))
    c = claims(spark, sf_dir).withColumn("status", status).withColumn("before", F.lag("status").over(w)).where("before is not null")
    return c.groupBy("before", "status").agg(F.count("*").alias("n"), F.first(ops.may_go(F.col("before"), F.col("status"))).alias("allowed"))


TRANSITIONS_SQL = """WITH c AS (SELECT o_custkey, o_orderdate, o_orderkey, ['draft', 'submitted', 'paid', 'partially_paid', 'rejected', 'lost'][o_orderkey * 7 % 6 + 1] AS status FROM orders),
t(a, b) AS (VALUES ('draft', 'submitted'), ('submitted', 'paid'), ('submitted', 'partially_paid'), ('submitted', 'rejected'), ('submitted', 'draft'),
  ('paid', 'partially_paid'), ('paid', 'rejected'), ('partially_paid', 'paid'), ('partially_paid', 'rejected'), ('rejected', 'paid'), ('rejected', 'partially_paid')),
b AS (SELECT status, lag(status) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS before FROM c)
SELECT before, status, count(*) AS n, (before = status AND before <> 'lost') OR (before, status) IN (SELECT (a, b) FROM t) AS allowed
FROM b WHERE before IS NOT NULL GROUP BY 1, 2"""


def confusion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against a rule of length, as counts."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    said = (F.col("n_chars") >= 400).cast("int")
    return d.groupBy("lang").agg(
        F.count_if((said == 1) & (F.col("quality") == 1)).alias("tp"), F.count_if((said == 1) & (F.col("quality") == 0)).alias("fp"),
        F.count_if((said == 0) & (F.col("quality") == 1)).alias("fn"), F.count_if((said == 0) & (F.col("quality") == 0)).alias("tn"),
    )


CONFUSION_SQL = """SELECT lang, count(*) FILTER (n_chars >= 400 AND quality = 1) AS tp, count(*) FILTER (n_chars >= 400 AND quality = 0) AS fp,
  count(*) FILTER (n_chars < 400 AND quality = 1) AS fn, count(*) FILTER (n_chars < 400 AND quality = 0) AS tn
FROM documents JOIN labels USING (doc_id) GROUP BY 1"""


def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = confusion_scores(spark, sf_dir).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")])
    worst = confusion_scores(spark, sf_dir).agg(F.min(F.col("tp") / (F.col("tp") + F.col("fn"))).alias("v"))
    rows = [("precision", F.col("tp") / (F.col("tp") + F.col("fp"))), ("recall", F.col("tp") / (F.col("tp") + F.col("fn")))]
    metrics = c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.round(v, 6).alias("value")) for n, v in rows])).alias("m")).select("m.*")
    metrics = metrics.unionByName(worst.select(F.lit("worst_recall").alias("metric"), F.round("v", 6).alias("value")))
    limits = [("precision", 0.9, None, True), ("recall", 0.99, None, True), ("worst_recall", 0.5, 1.0, True), ("leaks", None, 0.0, False), ("hits", 0.7, None, True)]
    return evals.gate_summary(metrics, spark.createDataFrame(limits, "metric string, low double, high double, required boolean"))


GATES_SQL = f"""WITH c AS ({CONFUSION_SQL}), m AS (
  SELECT 'precision' AS metric, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS value FROM c
  UNION ALL SELECT 'recall', round(sum(tp) / (sum(tp) + sum(fn)), 6) FROM c
  UNION ALL SELECT 'worst_recall', round(min(tp / (tp + fn)), 6) FROM c),
t(metric, low, high, required) AS (VALUES ('precision', 0.9, NULL, true), ('recall', 0.99, NULL, true), ('worst_recall', 0.5, 1.0, true), ('leaks', NULL, 0.0, false), ('hits', 0.7, NULL, true))
SELECT metric, value, CASE WHEN value IS NULL THEN CASE WHEN required THEN 'fail' ELSE 'skipped' END
  WHEN coalesce(value < low, false) OR coalesce(value > high, false) THEN 'fail' ELSE 'pass' END AS status FROM t LEFT JOIN m USING (metric)"""


def _extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part names with a number, against the same with words turned round, some fields wrong or lacking, some rows missing and
    some of another kind."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), k.alias("id"), F.md5(k.cast("string").cast("binary")).alias("name"), F.col("p_type").alias("kind"), F.col("p_name").alias("benefit_name"),
        F.col("p_retailprice").alias("limit_value"), F.when(k % 4 != 0, F.concat_ws(", ", F.lit("one"), "p_name")).alias("item_codes"), F.upper("p_type").alias("scope"),
    )
    turned = F.array_join(F.reverse(F.split("benefit_name", " ")), " ")
    q = p.where("id % 7 <> 0").withColumns(
        {"kind": F.when(F.col("id") % 11 == 0, "other").otherwise(F.col("kind")), "benefit_name": F.when(F.col("id") % 5 == 0, "quite another").otherwise(F.upper(turned)),
         "limit_value": F.when(F.col("id") % 3 != 0, F.col("limit_value") + F.when(F.col("id") % 3 == 1, 0.004).otherwise(0.02)),
         "item_codes": F.concat_ws(" ,", F.upper("benefit_name"), F.lit(" ONE ")), "scope": F.concat(F.lit(" "), F.lower("scope"))}
    )
    return p, q


def extraction_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows matched one to one within a brand, kinds equal."""
    p, q = _extracted(spark, sf_dir)
    return evals.greedy_match(p, q, "brand", kind="kind").select("brand", "golden_id", "predicted_id", (F.col("score") == 100).alias("whole"))


MATCHES_SQL = """WITH p AS (SELECT p_brand AS brand, p_partkey AS k FROM part)
SELECT brand, k AS golden_id, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 THEN k END AS predicted_id, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 THEN true END AS whole FROM p
UNION ALL SELECT brand, NULL, k, NULL FROM p WHERE k % 7 <> 0 AND k % 11 = 0"""


def extraction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields of matched rows are right, by brand."""
    p, q = _extracted(spark, sf_dir)
    matches = evals.greedy_match(p, q, "brand", kind="kind")
    return evals.field_accuracy(p, q, matches, "brand", ["benefit_name", "limit_value", "item_codes", "scope"])


ACCURACY_SQL = """WITH p AS (SELECT p_brand AS brand, p_partkey AS k FROM part), m AS (SELECT *, k % 7 <> 0 AND k % 11 <> 0 AS met FROM p),
f AS (SELECT brand, CASE WHEN met THEN (k % 5 <> 0)::INT + (k % 3 = 1)::INT + (k % 4 <> 0)::INT + 1 ELSE 0 END AS good,
  CASE WHEN met THEN 4 ELSE 3 + (k % 4 <> 0)::INT + CASE WHEN k % 7 <> 0 THEN 3 + (k % 3 <> 0)::INT ELSE 0 END END AS every FROM m)
SELECT brand, CAST(sum(good) AS BIGINT) AS correct, CAST(sum(every) AS BIGINT) AS total, sum(good) / sum(every) AS accuracy FROM f GROUP BY 1"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def conversation_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversation.replay(turns(spark, sf_dir), F.length("text") % 5 == 0)
    return out.select("conv_id", "turn", "role", "in_current_turn", "item")


REPLAY_SQL = """WITH u AS (SELECT conv_id, turn, role, text, role = 'assistant' AND length(text) % 5 = 0 AS bad,
    max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last_user FROM conversations WHERE role IN ('user', 'assistant')),
n AS (SELECT *, coalesce(lead(bad) OVER (PARTITION BY conv_id ORDER BY turn), false) AS next_bad FROM u)
SELECT conv_id, turn, role, turn > coalesce(last_user, -1) AS in_current_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS item
FROM n WHERE NOT bad AND NOT (role = 'user' AND next_bad) AND trim(text) <> ''"""


def history_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations cut to four turns and to two, begun by a system turn and ended by others."""
    t = turns(spark, sf_dir)
    every = [conversation.truncate(t, most).select("conv_id", "turn", "role", F.lit(most).alias("most")) for most in (60, 4, 1)]
    return every[0].unionByName(every[1]).unionByName(every[2])


def _truncate_sql(most: int) -> str:
    return f"""SELECT conv_id, turn, role, {most} AS most FROM (SELECT *, min(turn) FILTER (role = 'user' AND n <= {most}) OVER (PARTITION BY conv_id) AS first FROM n)
WHERE n <= {most} AND (many <= {most} OR turn >= first)"""


TRUNCATE_SQL = f"""WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, count(*) OVER (PARTITION BY conv_id) AS many FROM conversations)
{_truncate_sql(60)} UNION ALL {_truncate_sql(4)} UNION ALL {_truncate_sql(1)}"""


def router_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversation.router_context(turns(spark, sf_dir))
    return out.select("conv_id", "turn", F.md5(F.col("context").cast("binary")).alias("context_hash"))


ROUTER_SQL = """WITH c AS (SELECT conv_id, turn, role, coalesce(string_agg(role || ': ' || substr(text, 1, 300), chr(10))
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, turn, md5(context) AS context_hash FROM c WHERE role = 'user'"""


def _families() -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ("member", "policy", "id", "phone")]), (F.length("text") % 4 + 1).cast("int"))


def alias_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each conversation, turns' lengths as values that get letters or numbers by first sight."""
    v = turns(spark, sf_dir).select("conv_id", _families().alias("family"), (F.length("text") % 50).cast("bigint").alias("value"), "turn")
    return conversation.alias_tokens(v, "conv_id", "family", "value", "turn")


def _token_sql(family: str, i: str) -> str:
    letters = f"""CASE WHEN {i} < 26 THEN chr(CAST(65 + {i} AS INTEGER)) WHEN {i} < 702 THEN chr(CAST(65 + ({i} - 26) // 26 AS INTEGER)) || chr(CAST(65 + ({i} - 26) % 26 AS INTEGER))
    ELSE chr(CAST(65 + ({i} - 702) // 676 AS INTEGER)) || chr(CAST(65 + ({i} - 702) // 26 % 26 AS INTEGER)) || chr(CAST(65 + ({i} - 702) % 26 AS INTEGER)) END"""
    return f"'[' || {family} || '_' || CASE WHEN {family} IN ('POLICY', 'CERT', 'ID') THEN CAST({i} + 1 AS VARCHAR) ELSE {letters} END || ']'"


ALIAS_SQL = f"""WITH f AS (SELECT conv_id, ['member', 'policy', 'id', 'phone'][length(text) % 4 + 1] AS family, length(text) % 50 AS value, min(turn) AS first FROM conversations GROUP BY 1, 2, 3),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id, family ORDER BY first, value) - 1 AS i FROM f)
SELECT conv_id, family, CAST(value AS BIGINT) AS value, {_token_sql('upper(family)', 'i')} AS token FROM i"""


def allocated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' keys as values by brand, some of which have a stored token: indices that are taken are passed over."""
    p = table(spark, sf_dir, "part").select(
        F.element_at(F.array(F.lit("member"), F.lit("policy")), (F.col("p_partkey") % 2 + 1).cast("int")).alias("family"), F.col("p_partkey").alias("value"), "p_size"
    )
    stored = p.where("value % 5 = 0").select("family", "value", conversation.format_token(F.upper("family"), F.floor(F.col("value") / 2)).alias("token"))
    return conversation.allocate_tokens(p, stored, "family", "value", "p_size")


ALLOCATED_SQL = f"""WITH p AS (SELECT CASE p_partkey % 2 WHEN 0 THEN 'member' ELSE 'policy' END AS family, p_partkey AS value, p_size FROM part),
s AS (SELECT family, value, value // 2 AS i FROM p WHERE value % 5 = 0),
m AS (SELECT family, max(i) + count(*) AS top FROM p LEFT JOIN s USING (family, value) GROUP BY 1),
c AS (SELECT family, unnest(generate_series(0, top)) AS i FROM m),
free AS (SELECT family, i, row_number() OVER (PARTITION BY family ORDER BY i) AS r FROM c WHERE (family, i) NOT IN (SELECT (family, i) FROM s)),
n AS (SELECT family, value, row_number() OVER (PARTITION BY family ORDER BY p_size, value) AS r FROM p WHERE value % 5 <> 0),
e AS (SELECT family, value, i FROM s UNION ALL SELECT family, value, i FROM n JOIN free USING (family, r))
SELECT family, value, {_token_sql('upper(family)', 'i')} AS token FROM e"""


def message_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as the events of one message: texts that open again under a role's name, data that take
    the place of earlier ones, and calls of tools."""
    t = turns(spark, sf_dir)
    k = F.col("turn") % 4
    call = F.concat(F.lit("c"), F.floor(F.col("turn") / 8).cast("string"))
    event = (
        F.when(k == 0, F.to_json(F.struct(F.lit("text-start").alias("type"), F.col("role").alias("id"))))
        .when(k == 1, F.to_json(F.struct(F.lit("text-delta").alias("type"), F.col("role").alias("id"), F.length("text").cast("string").alias("delta"))))
        .when(k == 2, F.to_json(F.struct(F.lit("data-n").alias("type"), F.col("role").alias("id"), F.col("turn").alias("data"))))
        .otherwise(F.to_json(F.struct(F.when(F.col("turn") % 8 == 3, "tool-input-start").otherwise("tool-output-denied").alias("type"), call.alias("toolCallId"))))
    )
    return conversation.fold_messages(t.select(F.col("conv_id").alias("message_id"), F.col("turn").alias("seq"), event.alias("event"))).drop("json")


FOLD_SQL = """WITH t AS (SELECT *, turn % 4 AS k FROM conversations),
d AS (SELECT t.conv_id, t.role, t.turn FROM t WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM t o WHERE o.conv_id = t.conv_id AND o.role = t.role AND o.k < 2 AND o.turn < t.turn))
SELECT conv_id AS message_id, count(*) FILTER (k = 0) + (SELECT count(*) FROM d WHERE d.conv_id = t.conv_id) + count(DISTINCT role) FILTER (k = 2)
  + count(*) FILTER (turn % 8 = 3) AS parts, CAST(NULL AS VARCHAR) AS finish FROM t GROUP BY 1"""


def issue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues made from documents in two lists, those of the second with messages of their own."""
    d = table(spark, sf_dir, "documents")
    code = F.when(F.col("doc_id") % 2 == 0, "pii_advisory").otherwise(F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")))
    make = lambda df, mark: df.select(
        code.alias("code"), F.when(F.col("n_chars") % 9 > 0, F.col("n_chars") % 9).alias("page"), F.col("lang").alias("category"),
        F.col("source").alias("row_id"), F.concat(F.lit(mark), (F.col("doc_id") % 10).cast("string")).alias("message"), "doc_id",
    )
    return assembly.merge_issues(make(d.where("doc_id % 3 <> 0"), "z"), make(d, "a"), make(d, "z"), order="doc_id")


ISSUES_SQL = """WITH l(i, mark) AS (VALUES (0, 'z'), (1, 'a'), (2, 'z')),
i AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'pii_advisory' ELSE 'c' || doc_id % 3 END AS code, nullif(n_chars % 9, 0) AS page, lang AS category, source AS row_id,
  mark || doc_id % 10 AS message, doc_id, i FROM documents, l WHERE i > 0 OR doc_id % 3 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY code, page, category, row_id, CASE WHEN code = 'pii_advisory' THEN '' ELSE message END ORDER BY i, doc_id) AS n FROM i)
SELECT code, page, category, row_id, message, doc_id FROM n WHERE n = 1"""


QUERIES = {
    "metric_bins": (metric_bins, BINS_SQL),
    "weighted_p95": (weighted_p95, P95_SQL),
    "metric_pivot": (metric_pivot, PIVOT_SQL),
    "top_dependencies": (top_dependencies, TOP_SQL),
    "error_rate_alert": (error_rate_alert, ALERT_SQL),
    "daily_spend_gate": (daily_spend_gate, GATE_SQL),
    "budget_left": (budget_left, BUDGET_SQL),
    "usage_cost": (usage_cost, COST_SQL),
    "rate_limit": (rate_limit, RATE_SQL),
    "status_codes": (status_codes, STATUS_SQL),
    "claim_transitions": (claim_transitions, TRANSITIONS_SQL),
    "confusion_scores": (confusion_scores, CONFUSION_SQL),
    "gate_summary": (gate_summary, GATES_SQL),
    "extraction_matches": (extraction_matches, MATCHES_SQL),
    "extraction_accuracy": (extraction_accuracy, ACCURACY_SQL),
    "conversation_replay": (conversation_replay, REPLAY_SQL),
    "history_truncated": (history_truncated, TRUNCATE_SQL),
    "router_context": (router_context, ROUTER_SQL),
    "alias_tokens": (alias_tokens, ALIAS_SQL),
    "allocated_tokens": (allocated_tokens, ALLOCATED_SQL),
    "message_fold": (message_fold, FOLD_SQL),
    "issue_merge": (issue_merge, ISSUES_SQL),
}
