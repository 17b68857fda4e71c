"""Decision rules as column expressions, and the joins that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories that stop a text, and those that only advise.
HARD_CATEGORIES = (
    "CASocialInsuranceNumber",
    "CAHealthServiceNumber",
    "CAPersonalHealthIdentification",
    "CABankAccountNumber",
    "AUTaxFileNumber",
    "AUMedicalAccountNumber",
    "AUBankAccountNumber",
    "AUDriversLicenseNumber",
    "DateOfBirth",
)
SOFT_CATEGORIES = ("Person", "Organization", "Address", "PhoneNumber", "Email")
#: What group of the review each issue code is shown in; others in ``other``.
ISSUE_GROUPS = {
    "pii_advisory": "personal",
    "page_excluded": "excluded",
    "prompt_injection": "excluded",
    "ocr_empty": "excluded",
    "unsupported_row": "rows",
    "low_confidence": "rows",
    "ungrounded_quote": "rows",
    "verifier_rounds_exhausted": "rows",
}
#: Patterns of questions that are out of scope, of those on general rules, and of words that keep a question
#: with the plan all the same.
OFF_TOPIC = r"\b(poem|joke|weather|recipe|bitcoin|stock|football|movie|song|capital of|ignore (all|previous|your)|system prompt)\b"
KNOWLEDGE = (
    r"\b(tax|medical expenses?|metc|cra|medicare|levy|rebate|lifetime health cover|waiting periods? (for|in) (private|hospital)"
    r"|ohip|provincial plan|private health insurance rules?)\b"
)
ABOUT_PLAN = r"\b(my|covered|claim|left|remaining)\b"


def pii_tier(category: Column, confidence: Column, hard: float = 0.8, soft: float = 0.5) -> Column:
    """``hard`` for a sure enough hard category; ``advisory`` for those less sure and for soft ones; else null."""
    is_hard = category.isin(*HARD_CATEGORIES) & (confidence >= hard)
    known = category.isin(*HARD_CATEGORIES, *SOFT_CATEGORIES) & (confidence >= soft)
    return F.when(is_hard, "hard").when(known, "advisory")


def tier_counts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tier, category, n): hits (keys, category, confidence) by tier and category; those of no tier are left out."""
    told = hits.withColumn("tier", pii_tier(F.col("category"), F.col("confidence"))).where("tier is not null")
    return told.groupBy(*keys, "tier", "category").agg(F.count("*").alias("n"))


def advisories(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, category): each page and category with an advisory hit, once."""
    tier = pii_tier(F.col("category"), F.col("confidence"))
    return hits.where(tier == "advisory").select(*keys, "page", "category").distinct()


def issue_group(code: Column) -> Column:
    return F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in ISSUE_GROUPS.items()], F.lit("other"))


def needs_check(confidence: Column, verdict: Column, least: float = 0.7) -> Column:
    return (confidence < least) | F.coalesce(verdict == "unsupported", F.lit(False))


def unsafe(severities: Column, most: int = 4) -> Column:
    """Whether the worst of a map of severities is ``most`` or more."""
    return F.coalesce(F.array_max(F.map_values(severities)) >= most, F.lit(False))


def route(text: Column) -> Column:
    """``off_topic``, ``knowledge`` or ``plan_claims``, the default."""
    has = lambda p: F.coalesce(text.rlike(f"(?i){p}"), F.lit(False))
    return F.when(has(OFF_TOPIC), "off_topic").when(has(KNOWLEDGE) & ~has(ABOUT_PLAN), "knowledge").otherwise("plan_claims")


def relevant_pages(pages: DataFrame, triage: DataFrame, keys: list[str]) -> DataFrame:
    """Pages but those that triage says are irrelevant; pages it says nothing of stay."""
    said = triage.select(*keys, F.col("relevant").alias("__r"))
    return pages.join(said, keys, "left").where(F.coalesce("__r", F.lit(True))).drop("__r")


def rows_in_chunk(rows: DataFrame, chunk_pages: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose page is in their chunk, and issues for the others."""
    kept = rows.join(chunk_pages, keys, "left_semi")
    issues = rows.join(chunk_pages, keys, "left_anti").select(*keys, F.lit("row_dropped").alias("code"))
    return kept, issues


def uncovered_detections(detections: DataFrame, aliases: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Detections of whose length less than ``share`` lies under alias spans. Both: (keys, start, end)."""
    a = aliases.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"))
    overlap = F.greatest(F.lit(0), F.least("end", "__e") - F.greatest("start", "__s"))
    per = detections.join(a, keys, "left").groupBy(*detections.columns).agg(F.coalesce(F.sum(overlap), F.lit(0)).alias("__o"))
    return per.where(F.col("__o") < share * (F.col("end") - F.col("start"))).drop("__o")


def plain_url(url: Column) -> Column:
    """A URL without fragment and trailing slash."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def resolve_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds source_id: by URL, else by the id before a chunk's number, else by the bare id.

    ``citations`` has (ref), ``sources`` (source_id string, url).
    """
    by_url = sources.select(plain_url(F.col("url")).alias("__u"), F.col("source_id").alias("__a"))
    by_chunk = sources.select(F.col("source_id").alias("__b"))
    by_id = sources.select(F.col("source_id").alias("__c"))
    c = citations.withColumns({"__u": plain_url(F.col("ref")), "__p": F.regexp_extract("ref", r"^(.+)-\d+$", 1)})
    out = c.join(by_url, "__u", "left").join(by_chunk, F.col("__p") == F.col("__b"), "left").join(by_id, F.col("ref") == F.col("__c"), "left")
    return out.withColumn("source_id", F.coalesce("__a", "__b", "__c")).select(*citations.columns, "source_id")


def citation_ok(source: Column, index: Column, licence_same: Column, attribution: Column, overruns: Column) -> Column:
    """Whether a citation may stand: a known source that may be indexed, its licence and attribution given, no overrun."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return source.isNotNull() & yes(index) & yes(licence_same) & yes(F.trim(attribution) != "") & (F.coalesce(overruns, F.lit(0)) == 0)


def allowed_calls(calls: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``allowed`` to calls, by an allow table."""
    return calls.join(allowed.select(*keys).distinct().withColumn("__a", F.lit(True)), keys, "left").withColumn("allowed", F.coalesce("__a", F.lit(False))).drop("__a")


def merge_members(known: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """Members of both sides, what is known before what is found."""
    a, b = known.select(key, F.col(value).alias("__a")), found.select(key, F.col(value).alias("__b"))
    return a.join(b, key, "full").select(key, F.coalesce("__a", "__b").alias(value), F.col("__a").isNull().alias("added"))


def last_wins(*frames: DataFrame, key: str) -> DataFrame:
    """Rows by key, of several frames the last one's."""
    every = None
    for i, df in enumerate(frames):
        one = df.withColumn("__i", F.lit(i))
        every = one if every is None else every.unionByName(one)
    w = Window.partitionBy(key).orderBy(F.desc("__i"))
    return every.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__i")


def span_boxes(spans: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, span, left, right, n): the extent of the words that each span touches. ``words``: (key, start, end, left, right)."""
    w = words.select(key, F.col("start").alias("__s"), F.col("end").alias("__e"), "left", "right")
    hit = spans.join(w, key).where((F.col("__s") < F.col("end")) & (F.col("__e") > F.col("start")))
    return hit.groupBy(key, "span").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.count("*").alias("n"))


def best_per_source(hits: DataFrame, keys: list[str], score: str) -> DataFrame:
    return hits.groupBy(*keys).agg(F.max(score).alias(score))


def scenario_scores(required: DataFrame, calls: DataFrame, caps: DataFrame, forbidden: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """(scenario, missing, mismatched, forbidden, over, wrong_facts, tools_ok, passed), counted.

    ``required`` (scenario, place, tool, arguments or null): a requirement may be met by any of several tools, rows of one
    place; it is missing if none was called, mismatched if it names arguments and no call of its tools has them.
    ``calls`` (scenario, tool, arguments). ``caps`` (tool, most). ``forbidden`` (scenario, tool). ``facts`` (scenario, holds).
    """
    met = required.join(calls.select("scenario", "tool", F.col("arguments").alias("__a"), F.lit(True).alias("__c")), ["scenario", "tool"], "left")
    per = met.groupBy("scenario", "place").agg(
        F.coalesce(F.bool_or("__c"), F.lit(False)).alias("called"), F.bool_or(F.col("arguments").isNotNull()).alias("named"),
        F.coalesce(F.bool_or(F.when(F.col("__c"), F.col("arguments").isNull() | (F.col("arguments") == F.col("__a")))), F.lit(False)).alias("same"),
    )
    parts = [
        per.groupBy("scenario").agg(F.count_if(~F.col("called")).alias("missing"), F.count_if(F.col("called") & F.col("named") & ~F.col("same")).alias("mismatched")),
        calls.groupBy("scenario", "tool").agg(F.count("*").alias("n")).join(caps, "tool").where("n > most").groupBy("scenario").agg(F.count("*").alias("over")),
    ]
    if forbidden is not None:
        parts.append(forbidden.join(calls, ["scenario", "tool"], "left_semi").groupBy("scenario").agg(F.count("*").alias("forbidden")))
    if facts is not None:
        parts.append(facts.groupBy("scenario").agg(F.count_if(~F.coalesce("holds", F.lit(False))).alias("wrong_facts")))
    out = required.select("scenario").union(calls.select("scenario")).distinct()
    for p in parts:
        out = out.join(p, "scenario", "left")
    names = ["missing", "mismatched", "forbidden", "over", "wrong_facts"]
    out = out.select("scenario", *[(F.coalesce(c, F.lit(0)) if c in out.columns else F.lit(0)).cast("bigint").alias(c) for c in names])
    tools = (F.col("missing") == 0) & (F.col("mismatched") == 0) & (F.col("forbidden") == 0) & (F.col("over") == 0)
    return out.withColumn("tools_ok", tools).withColumn("passed", F.col("tools_ok") & (F.col("wrong_facts") == 0))


def pass_rate(passed: Column, failed: Column) -> Column:
    """Share of those decided; null if none are."""
    return F.try_divide(passed, passed + failed)


def unpivot_rates(df: DataFrame, key: str, suffix: str = "_asr") -> DataFrame:
    """(key, attack, rate) from columns whose names end in ``suffix``."""
    cols = [c for c in df.columns if c.endswith(suffix)]
    long = df.unpivot([key], cols, "attack", "rate")
    return long.withColumn("attack", F.regexp_replace("attack", f"{suffix}$", ""))


def listed_by_status(df: DataFrame, key: str, status: str, name: str, order: list[str]) -> DataFrame:
    """(key, status, place, names): names by status, statuses in a fixed order."""
    per = df.groupBy(key, status).agg(F.array_join(F.sort_array(F.collect_set(name)), ",").alias("names"))
    return per.withColumn("place", F.array_position(F.array(*[F.lit(s) for s in order]), F.col(status)))
