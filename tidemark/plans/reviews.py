"""Queries over review rules, citations, ingestion reports and evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, ingest, known_values, ops, rules
from ..operators.joins import bounded
from ..sources.adapter import table


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({n}) % {len(values)} + 1]"


CATEGORIES = ["CASocialInsuranceNumber", "Email", "CreditCardNumber", "Organization", "DateOfBirth", "AUDriversLicenseNumber", "Person"]
CODES = ["pii_advisory", "page_excluded", "prompt_injection", "ocr_empty", "unsupported_row", "low_confidence", "ungrounded_quote", "verifier_rounds_exhausted", "duplicate_removed"]


def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier, group and checks of rows made from documents' numbers."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    confidence = (F.col("n_chars") % 101) / 100
    worst = rules.unsafe(F.create_map(F.lit("violence"), (i % 7).cast("int"), F.lit("hate"), (i % 3).cast("int")))
    verdict = F.when(i % 4 == 0, "unsupported").when(i % 4 == 1, "supported")
    return d.select(
        "doc_id", rules.pii_tier(_pick(CATEGORIES, i), confidence).alias("tier"), rules.issue_group(_pick(CODES, i)).alias("issue_group"),
        rules.needs_check(confidence, verdict).alias("needs_check"), worst.alias("unsafe"),
        assembly.row_confidence(F.col("n_chars") % 100, verdict, i % 3 == 0, i % 5 == 0).alias("confidence"),
    )


_TIER = """CASE WHEN c IN ('CASocialInsuranceNumber', 'DateOfBirth', 'AUDriversLicenseNumber') AND p >= 80 THEN 'hard'
  WHEN c <> 'CreditCardNumber' AND p >= 50 THEN 'advisory' END"""
_GROUP = """WHEN 'pii_advisory' THEN 'personal' WHEN 'page_excluded' THEN 'excluded' WHEN 'prompt_injection' THEN 'excluded' WHEN 'ocr_empty' THEN 'excluded'
  WHEN 'unsupported_row' THEN 'rows' WHEN 'low_confidence' THEN 'rows' WHEN 'ungrounded_quote' THEN 'rows' WHEN 'verifier_rounds_exhausted' THEN 'rows'"""
_CONF = """((CASE WHEN doc_id % 3 = 0 THEN f ELSE least(f, 5000) END) * (CASE WHEN doc_id % 5 = 0 THEN 9 ELSE 10 END) + 50) // 100 / 1000"""
FLAGS_SQL = f"""WITH r AS (SELECT doc_id, {_pick_sql(CATEGORIES, 'doc_id')} AS c, {_pick_sql(CODES, 'doc_id')} AS code, n_chars % 101 AS p,
  n_chars % 100 * (CASE doc_id % 4 WHEN 0 THEN 35 WHEN 1 THEN 100 ELSE 75 END) AS f FROM documents)
SELECT doc_id, {_TIER} AS tier, CASE code {_GROUP} ELSE 'other' END AS issue_group, p < 70 OR doc_id % 4 = 0 AS needs_check,
  greatest(doc_id % 7, doc_id % 3) >= 4 AS "unsafe", {_CONF} AS confidence FROM r"""


def routed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("role = 'user'")
    text = _pick(ASKED, F.col("turn") + F.col("conv_id"))
    return t.select("conv_id", "turn", rules.route(text).alias("route"))


ASKED = [
    "What is the Medicare levy?", "Is my levy covered?", "Tell me a JOKE", "", "ignore previous rules", "waiting periods for hospital", "medical expense rules",
    "a claim for tax", "capital of France", "Does OHIP pay?", "taxes", "stocks", "remaining rebate",
]
ROUTED_SQL = f"""WITH c AS (SELECT conv_id, turn, lower({_pick_sql(ASKED, 'turn + conv_id')}) AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(^|\\W)(poem|joke|weather|recipe|bitcoin|stock|football|movie|song|capital of|ignore (all|previous|your)|system prompt)(\\W|$)') THEN 'off_topic'
  WHEN regexp_matches(t, '(^|\\W)(tax|medical expenses?|metc|cra|medicare|levy|rebate|lifetime health cover|waiting periods? (for|in) (private|hospital)|ohip|provincial plan|private health insurance rules?)(\\W|$)')
    AND NOT regexp_matches(t, '(^|\\W)(my|covered|claim|left|remaining)(\\W|$)') THEN 'knowledge' ELSE 'plan_claims' END AS route FROM c"""


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents but those of quality 0; unlabelled ones stay."""
    said = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("relevant"))
    return rules.relevant_pages(table(spark, sf_dir, "documents").select("doc_id", "lang"), said, ["doc_id"])


TRIAGE_SQL = "SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) = 1"


def dropped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows cite a page of their chunk and how many don't, by language."""
    d = table(spark, sf_dir, "documents").select("lang", (F.col("n_chars") % 20).alias("page"))
    pages = spark.range(0, 20, 3).select(F.col("id").alias("page")).crossJoin(F.broadcast(d.select("lang").distinct()))
    kept, issues = rules.rows_in_chunk(d, pages, ["lang", "page"])
    both = kept.select("lang", F.lit("kept").alias("code")).unionByName(issues.select("lang", "code"))
    return both.groupBy("lang", "code").agg(F.count("*").alias("n"))


DROPPED_SQL = """SELECT lang, CASE WHEN n_chars % 20 % 3 = 0 THEN 'kept' ELSE 'row_dropped' END AS code, count(*) AS n FROM documents GROUP BY 1, 2"""


def _spans(df: DataFrame, count: int, factor: int, width: int) -> DataFrame:
    s = df.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("span"))
    start = (F.col("doc_id") * factor + F.col("span") * 13) % 70
    return s.select("doc_id", "span", start.alias("start"), (start + width + F.col("span")).alias("end"))


def _spans_sql(name: str, count: int, factor: int, width: int) -> str:
    return f"""{name} AS (SELECT doc_id, span, (doc_id * {factor} + span * 13) % 70 AS start, (doc_id * {factor} + span * 13) % 70 + {width} + span AS "end"
  FROM (SELECT doc_id, unnest(generate_series(1, {count})) AS span FROM documents))"""


def uncovered_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return rules.uncovered_detections(_spans(d, 4, 7, 5), _spans(d, 2, 3, 12).drop("span"), ["doc_id"])


UNCOVERED_SQL = f"""WITH {_spans_sql('d', 4, 7, 5)}, {_spans_sql('a', 2, 3, 12)},
o AS (SELECT d.doc_id, d.span, d.start, d."end", sum(greatest(0, least(d."end", a."end") - greatest(d.start, a.start))) AS o
  FROM d JOIN a USING (doc_id) GROUP BY ALL)
SELECT doc_id, CAST(span AS INTEGER) AS span, start, "end" FROM o WHERE o < 0.5 * ("end" - start)"""


def span_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of the words under spans: word k of a document is at 10 k to 10 k + 7, drawn at 3 k to 3 k + 2."""
    d = table(spark, sf_dir, "documents")
    k = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")
    words = d.select("doc_id", k).select("doc_id", (F.col("k") * 10).alias("start"), (F.col("k") * 10 + 7).alias("end"), (F.col("k") * 3).alias("left"), (F.col("k") * 3 + 2).alias("right"))
    return rules.span_boxes(_spans(d, 3, 11, 9), words, "doc_id")


BOXES_SQL = f"""WITH {_spans_sql('s', 3, 11, 9)}, w AS (SELECT unnest(generate_series(0, 9)) AS k)
SELECT doc_id, CAST(span AS INTEGER) AS span, CAST(min(3 * k) AS INTEGER) AS "left", CAST(max(3 * k + 2) AS INTEGER) AS "right", count(*) AS n
FROM s JOIN w ON 10 * k < "end" AND 10 * k + 7 > start GROUP BY 1, 2"""


def citation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of pages by address, by chunk, by bare id and wrongly, resolved and counted."""
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    source = F.concat(F.lit("src"), i.cast("string"))
    sources = p.select(source.alias("source_id"), F.concat(F.lit("https://h/"), i.cast("string"), F.lit("/")).alias("url"), (i % 6 != 0).alias("index"))
    ref = (
        F.when(i % 4 == 0, F.concat(F.lit("https://h/"), i.cast("string"), F.lit("/#part"))).when(i % 4 == 1, F.concat(source, F.lit("-17")))
        .when(i % 4 == 2, source).otherwise(F.lit("nowhere"))
    )
    found = rules.resolve_citations(p.select("page_id", ref.alias("ref")), sources)
    joined = found.join(sources.select("source_id", "index"), "source_id", "left")
    ok = rules.citation_ok(F.col("source_id"), F.col("index"), F.lit(True), F.when(i % 5 != 0, "a"), F.lit(0))
    return joined.select("page_id", "source_id", ok.alias("ok"))


CITATIONS_SQL = """SELECT page_id, CASE WHEN page_id % 4 < 3 THEN 'src' || page_id END AS source_id,
  page_id % 4 < 3 AND page_id % 6 <> 0 AND page_id % 5 <> 0 AS ok FROM pages"""


def tool_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("depth", (F.col("event_id") % 2).cast("int"))
    allowed = spark.createDataFrame([("click", 0), ("view", 0), ("view", 1)], "event_type string, depth int")
    calls = rules.allowed_calls(e.select("event_type", "depth"), bounded(allowed), ["event_type", "depth"])
    return calls.groupBy("event_type", "depth").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("n"))


ALLOW_SQL = """SELECT event_type, CAST(event_id % 2 AS INTEGER) AS depth,
  count(*) FILTER (event_type = 'view' OR (event_type = 'click' AND event_id % 2 = 0)) AS allowed, count(*) AS n FROM events GROUP BY 1, 2"""


def merged_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("member_id"), F.col("c_name").alias("name"))
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("member_id")).agg(F.min("o_orderpriority").alias("name"))
    return rules.merge_members(known, found, "member_id", "name")


MEMBERS_SQL = """WITH k AS (SELECT c_custkey AS member_id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0),
f AS (SELECT o_custkey AS member_id, min(o_orderpriority) AS name FROM orders GROUP BY 1)
SELECT member_id, coalesce(k.name, f.name) AS name, k.name IS NULL AS added FROM k FULL JOIN f USING (member_id)"""


def row_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a = d.select(F.col("doc_id").alias("row_id"), F.lit("first").alias("origin"))
    return rules.last_wins(a, d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("origin")), key="row_id")


SOURCES_SQL = "SELECT doc_id AS row_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'first' END AS origin FROM documents"


def ops_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three one-row aggregates beside each other."""
    e, d = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    a = e.agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
    b = d.agg(F.countDistinct("source").alias("sources"))
    c = table(spark, sf_dir, "conversations").agg(F.max("turn").alias("longest"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))


SUMMARY_SQL = """SELECT (SELECT count(*) FROM events) AS requests, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors,
  (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT max(turn) FROM conversations) AS longest"""


def retrieved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return rules.best_per_source(d.select("source", "lang", (F.col("n_chars") % 1000).alias("score")), ["source", "lang"], "score")


RETRIEVED_SQL = "SELECT source, lang, max(n_chars % 1000) AS score FROM documents GROUP BY 1, 2"


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run over pages, by host, with statuses by their numbers and the errors of failed ones."""
    p, n = table(spark, sf_dir, "pages"), F.col("page_id")
    status = _pick(["changed", "unchanged", "failed", "link_only", "failed"], n)
    rows = p.select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), status.alias("status"), _pick(["timeout", "http_404", "robots"], n).alias("error"),
        F.when(n % 5 < 2, n % 9).otherwise(0).alias("chunks"), F.when(n % 5 < 2, n % 3).otherwise(0).alias("empty_chunks"),
    )
    return ingest.run_report(rows, ["host"])


REPORT_SQL = """WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, page_id % 5 AS s, ['timeout', 'http_404', 'robots'][page_id % 3 + 1] AS e,
  CASE WHEN page_id % 5 < 2 THEN page_id % 9 ELSE 0 END AS c, CASE WHEN page_id % 5 < 2 THEN page_id % 3 ELSE 0 END AS z FROM pages),
f AS (SELECT host, string_agg(e || ' × ' || n, ', ' ORDER BY e) AS failures FROM (SELECT host, e, count(*) AS n FROM p WHERE s IN (2, 4) GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT host, count(*) FILTER (s < 2) AS fetched, count(*) FILTER (s = 0) AS changed, count(*) FILTER (s = 1) AS unchanged, count(*) FILTER (s IN (2, 4)) AS failed,
  count(*) FILTER (s = 3) AS link_only, CAST(sum(c) AS BIGINT) AS chunks, round(coalesce(sum(z) / nullif(sum(c + z), 0), 0.0::DOUBLE), 4) AS empty_rate FROM p GROUP BY 1)
SELECT r.*, failures FROM r LEFT JOIN f USING (host)"""


def attack_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    wide = e.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(f"{t}_asr") for t in ("click", "error", "view")])
    return rules.unpivot_rates(wide, "user_id")


ATTACK_SQL = " UNION ALL ".join(f"SELECT user_id, '{t}' AS attack, count(*) FILTER (event_type = '{t}') AS rate FROM events GROUP BY 1" for t in ("click", "error", "view"))


def scenario_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the calls of a scenario: two requirements, the second met by either of two tools and one of
    them with arguments, a forbidden tool, caps, and a fact."""
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("user_id").alias("scenario"), F.col("event_type").alias("tool"), (F.col("event_id") % 40).cast("string").alias("arguments"))
    s = calls.groupBy("scenario").agg(F.count("*").alias("n"))
    row = lambda place, tool, arguments: F.struct(F.lit(place).alias("place"), tool.alias("tool"), arguments.cast("string").alias("arguments"))
    none = F.lit(None)
    rows = F.array(
        row(1, F.when(F.col("scenario") % 5 == 0, "refund").otherwise("signup"), none), row(2, F.lit("refund"), none),
        row(2, F.lit("click"), F.when(F.col("scenario") % 2 == 0, "7")),
    )
    need = s.select("scenario", F.explode(rows).alias("r")).select("scenario", "r.*")
    caps = spark.createDataFrame([("error", 14), ("view", 20)], "tool string, most bigint")
    bad = s.select("scenario", F.when(F.col("scenario") % 3 == 0, "purchase").otherwise("nothing").alias("tool"))
    facts = s.select("scenario", (F.col("n") % 4 != 0).alias("holds"))
    return rules.scenario_scores(need, calls, bounded(caps), bad, facts)


SCENARIO_SQL = """WITH s AS (SELECT user_id AS scenario, count(*) AS n, count(*) FILTER (event_type = 'signup') AS a, count(*) FILTER (event_type = 'click') AS b,
  count(*) FILTER (event_type = 'click' AND event_id % 40 = 7) AS b7, count(*) FILTER (event_type = 'error') AS c, count(*) FILTER (event_type = 'view') AS v,
  count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1),
m AS (SELECT scenario, CAST((a = 0 OR scenario % 5 = 0)::INT + (b = 0)::INT AS BIGINT) AS missing, CAST((b > 0 AND b7 = 0 AND scenario % 2 = 0)::INT AS BIGINT) AS mismatched,
  CAST((p > 0 AND scenario % 3 = 0)::INT AS BIGINT) AS forbidden, CAST((c > 14)::INT + (v > 20)::INT AS BIGINT) AS over, CAST((n % 4 = 0)::INT AS BIGINT) AS wrong_facts FROM s)
SELECT *, missing + mismatched + forbidden + over = 0 AS tools_ok, missing + mismatched + forbidden + over + wrong_facts = 0 AS passed FROM m"""


def status_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name")
    return rules.listed_by_status(p, "p_brand", "p_type", "p_name", ["STANDARD", "ECONOMY", "PROMO"])


LISTS_SQL = """SELECT p_brand, p_type, array_to_string(list_sort(list_distinct(list(p_name))), ',') AS names,
  CAST(CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 2 WHEN 'PROMO' THEN 3 ELSE 0 END AS BIGINT) AS place FROM part GROUP BY 1, 2"""


def plan_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat rows to nested plans and back."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("plan_id"), F.col("p_type").alias("category_name"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("benefit_name"),
        (F.col("p_size") % 10 * 10).cast("double").alias("percent"), F.col("p_retailprice").alias("limit_dollars"), F.lit("a, b").alias("keywords"),
    )
    return assembly.explode_plan(assembly.assemble_plan(p)).withColumn("limit_dollars", F.round("limit_dollars", 2))


ROUND_TRIP_SQL = """SELECT p_brand AS plan_id, p_type AS category_name, p_name || ' ' || p_partkey AS benefit_name, CAST(p_size % 10 * 10 AS DOUBLE) AS percent,
  round(p_retailprice, 2) AS limit_dollars, 'a, b' AS keywords FROM part"""


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.unique_ids(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"])


UNIQUE_SQL = """WITH n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, p_name, CASE WHEN n = 1 THEN p_name ELSE p_name || '-' || n END AS id FROM n"""


def learned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that follow a label in any document of a source, found in all documents of it. Every tenth document gets a line
    with the reference number that it is known by, the others one that only mentions the next such number."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    number = lambda k: F.lpad((k - k % 10).cast("string"), 7, "0")
    line = F.when(n % 10 == 0, F.concat(F.lit("Claim number: "), number(n))).otherwise(F.concat(F.lit("see "), F.regexp_replace(number(n), "^(...)", "$1 "), F.lit(" there")))
    text = F.concat_ws("\n", line, "text")
    found = known_values.learn_and_find(d.select("doc_id", "source", text.alias("text")), "source")
    return found.where("end <= 30").select("doc_id", "start", "end", "value", "known")


# a number counts in the documents of its source alone; a space within it is passed over
LEARNED_SQL = """WITH d AS (SELECT doc_id, source, lpad(CAST(doc_id - doc_id % 10 AS VARCHAR), 7, '0') AS n FROM documents)
SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 14 ELSE 4 END AS start, CASE WHEN d.doc_id % 10 = 0 THEN 21 ELSE 12 END AS end,
  CASE WHEN d.doc_id % 10 = 0 THEN d.n ELSE d.n[1:3] || ' ' || d.n[4:7] END AS value, d.n AS known
FROM d WHERE EXISTS (SELECT 1 FROM d e WHERE e.source = d.source AND e.n = d.n AND e.doc_id % 10 = 0)"""


def request_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.guards import capped_bytes

    t = table(spark, sf_dir, "conversations").withColumn("bytes", F.octet_length("text"))
    return capped_bytes(t, "conv_id", "turn", "bytes", 2000).select("conv_id", "turn", "over")


BYTES_SQL = "SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) > 2000 AS over FROM conversations"


def verdict_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language how many rows a verifier would not support, and whether that is too many."""
    bad = F.count_if(F.col("n_chars") % 6 == 0)
    per = table(spark, sf_dir, "documents").groupBy("lang").agg(bad.alias("unsupported"), F.count("*").alias("n"))
    return per.withColumn("again", 100 * F.col("unsupported") > 15 * F.col("n"))


VERDICT_SQL = """SELECT lang, count(*) FILTER (n_chars % 6 = 0) AS unsupported, count(*) AS n, 100 * count(*) FILTER (n_chars % 6 = 0) > 15 * count(*) AS again
FROM documents GROUP BY 1"""


def status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    codes = ["prompt_injection", "ai_disabled", "payload_too_large", "x", "invalid_request", "upstream_error", "budget_exhausted"]
    return e.select("event_id", ops.status_of(_pick(codes, F.col("event_id"))).alias("status"))


STATUS_MAP_SQL = "SELECT event_id, CAST([422, 503, 413, 500, 400, 502, 429][event_id % 7 + 1] AS INTEGER) AS status FROM events"

QUERIES = {
    "review_flags": (review_flags, FLAGS_SQL),
    "routed_turns": (routed_turns, ROUTED_SQL),
    "triage": (triage, TRIAGE_SQL),
    "dropped_rows": (dropped_rows, DROPPED_SQL),
    "uncovered_detections": (uncovered_detections, UNCOVERED_SQL),
    "span_boxes": (span_boxes, BOXES_SQL),
    "citation_sources": (citation_sources, CITATIONS_SQL),
    "tool_allowlist": (tool_allowlist, ALLOW_SQL),
    "merged_members": (merged_members, MEMBERS_SQL),
    "row_sources": (row_sources, SOURCES_SQL),
    "ops_summary": (ops_summary, SUMMARY_SQL),
    "retrieved_sources": (retrieved_sources, RETRIEVED_SQL),
    "ingest_report": (ingest_report, REPORT_SQL),
    "attack_rates": (attack_rates, ATTACK_SQL),
    "scenario_scores": (scenario_scores, SCENARIO_SQL),
    "status_lists": (status_lists, LISTS_SQL),
    "plan_round_trip": (plan_round_trip, ROUND_TRIP_SQL),
    "unique_names": (unique_names, UNIQUE_SQL),
    "learned_values": (learned_values, LEARNED_SQL),
    "request_bytes": (request_bytes, BYTES_SQL),
    "verdict_share": (verdict_share, VERDICT_SQL),
    "status_map": (status_map, STATUS_MAP_SQL),
}
