"""Names linked to what they mean: benefits, pools and targets of cost shares, by likeness, with fallbacks and issues.

All tables have the keys of a plan; names only meet targets of their own plan, over an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distinct_list, names_match, scored, slug

#: The likeness from which names are linked, how many keywords of a benefit count, and what they lose.
LINK_SCORE = 88.0
KEYWORDS = 8
KEYWORD_LOSS = 3.0


def _form(text: Column, loss: float) -> Column:
    return F.struct(text.alias("form"), F.lit(loss).alias("loss"))


def benefit_forms(name: Column, keywords: Column) -> Column:
    """What a benefit answers to: its name, and its first keywords at a loss."""
    listed = F.slice(F.coalesce(keywords, F.array().cast("array<string>")), 1, KEYWORDS)
    return F.concat(F.array(_form(name, 0.0)), F.transform(listed, lambda k: _form(k, KEYWORD_LOSS)))


def category_forms(name: Column, kind: Column) -> Column:
    """What a category answers to: its name and its kind, in words."""
    return F.array(_form(name, 0.0), _form(F.replace(kind, F.lit("_"), F.lit(" ")), 0.0))


def best_match(asked: DataFrame, targets: DataFrame, keys: list[str], threshold: float = LINK_SCORE) -> DataFrame:
    """(keys, name, target_id, score): for each distinct name the target it is most like, the first by place of equals,
    if that is like enough.

    ``asked`` (keys, name), ``targets`` (keys, target_id, place, forms).
    """
    names = asked.select(*keys, "name").where(F.trim("name") != "").distinct()
    forms = targets.select(*keys, "target_id", "place", F.explode("forms").alias("f")).select(*keys, "target_id", "place", "f.*")
    pairs = names.join(forms, keys).withColumn("score", scored(names_match)("name", "form") - F.col("loss"))
    order = F.struct("score", (-F.col("place")).alias("place"))
    best = pairs.groupBy(*keys, "name").agg(F.max_by("target_id", order).alias("target_id"), F.max("score").alias("score"))
    return best.where(F.col("score") >= threshold)


def match_benefits(asked: DataFrame, benefits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, benefit_id, score) for names (keys, name) among benefits (keys, benefit_id, place, name, keywords)."""
    targets = benefits.select(*keys, F.col("benefit_id").alias("target_id"), "place", benefit_forms(F.col("name"), F.col("keywords")).alias("forms"))
    return best_match(asked, targets, keys).withColumnRenamed("target_id", "benefit_id")


def _issues(df: DataFrame, keys: list[str], code: str, severity: str) -> DataFrame:
    return df.select(*keys, "row_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"))


def build_pools(rows: DataFrame, benefit_rows: DataFrame, benefits: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pools, the pool of each benefit, and issues.

    ``rows`` (keys, row_id, pool_name, unit, amount, benefit_names, confidence, place): the surest row of a pool's id
    makes it, ties by place; rows without unit or amount make none. ``benefit_rows`` (keys, row_id, benefit_name,
    pool_name): a benefit may name its pool itself. ``benefits``: see ``match_benefits``.

    Pools are (keys, pool_id, name, unit, value, rank): value in cents for dollars, else as a whole number. The pool of a
    benefit, (keys, benefit_id, pool_id), is the first by rank that lists it. Issues: ``field_missing``, ``unlinked_pool``.
    """
    r = rows.withColumn("pool_id", F.concat(F.lit("pool-"), F.when(slug(F.col("pool_name")) == "item", "pool").otherwise(slug(F.col("pool_name")))))
    amount = F.col("amount").cast("decimal(20,6)")
    value = F.when(F.col("unit") == "dollars", F.round(amount * 100)).otherwise(F.bround(amount)).cast("bigint")
    r = r.withColumn("value", value)
    order = [F.desc("confidence"), "place"]
    good = r.where("unit is not null and value >= 0")
    first = good.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "pool_id").orderBy(*order))).where("n = 1")
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    unit = F.when(F.col("unit") == "dollars", "cents").otherwise(F.col("unit"))
    pools = first.select(*keys, "pool_id", F.trim("pool_name").alias("name"), unit.alias("unit"), "value", "rank")
    # a row without an amount is told of unless a surer one has made its pool already
    made = first.select(*keys, "pool_id", F.col("confidence").alias("c"), F.col("place").alias("p"))
    lacking = r.where("unit is null or amount is null").join(made, [*keys, "pool_id"], "left")
    lacking = lacking.where("c is null or confidence > c or (confidence = c and place < p)")
    issues = _issues(lacking, keys, "field_missing", "warning")

    named = first.select(*keys, "row_id", "pool_id", "rank", F.posexplode(distinct_list(F.col("benefit_names"))).alias("at", "name"))
    own = benefit_rows.where(F.coalesce(F.trim("pool_name"), F.lit("")) != "").select(*keys, "row_id", F.col("benefit_name").alias("name"), "pool_name")
    found = match_benefits(named.select(*keys, "name").union(own.select(*keys, "name")), benefits, keys).select(*keys, "name", "benefit_id")
    listed = named.join(found, [*keys, "name"], "left")
    targets = first.select(*keys, F.col("pool_id").alias("target_id"), F.col("rank").alias("place"), F.array(_form(F.col("pool_name"), 0.0)).alias("forms"))
    pool_of = best_match(own.select(*keys, F.col("pool_name").alias("name")), targets, keys)
    pool_of = pool_of.select(*keys, F.col("name").alias("pool_name"), F.col("target_id").alias("pool_id"))
    said = own.join(pool_of, [*keys, "pool_name"], "left").join(found, [*keys, "name"], "left")
    for part in (listed.where("benefit_id is null"), said.where("benefit_id is null or pool_id is null")):
        issues = issues.unionByName(_issues(part, keys, "unlinked_pool", "warning"))

    links = listed.select(*keys, "benefit_id", "pool_id").union(said.select(*keys, "benefit_id", "pool_id")).dropna().distinct()
    ranked = links.join(first.select(*keys, "pool_id", "rank"), [*keys, "pool_id"])
    per = ranked.groupBy(*keys, "benefit_id").agg(F.min_by("pool_id", "rank").alias("pool_id"), F.count("*").alias("n"))
    others = per.where("n > 1").select(*keys, F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))), F.lit(None).cast(rows.schema["row_id"].dataType).alias("row_id"))
    issues = issues.unionByName(_issues(others, keys, "unlinked_pool", "info"))
    return pools, per.select(*keys, "benefit_id", "pool_id"), issues


def share_targets(rows: DataFrame, categories: DataFrame, benefits: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What cost shares apply to, (keys, share_id, category_id, benefit_id), and issues ``unlinked_cost_share``.

    ``rows`` (keys, row_id, name, applies_to, confidence, place): the surest row of a share's id counts. A target is a
    category (keys, category_id, place, name, kind) if one is like enough, else a benefit; else it is told of, as are
    rows that name none.
    """
    made = F.when(slug(F.col("name")) == "item", "cost-share").otherwise(slug(F.col("name")))
    r = rows.withColumn("share_id", F.concat(F.lit("cs-"), made))
    w = Window.partitionBy(*keys, "share_id").orderBy(F.desc("confidence"), "place")
    r = r.withColumn("n", F.row_number().over(w)).where("n = 1")
    asked = r.select(*keys, "row_id", "share_id", F.explode(distinct_list(F.col("applies_to"))).alias("name"))
    targets = categories.select(*keys, F.col("category_id").alias("target_id"), "place", category_forms(F.col("name"), F.col("kind")).alias("forms"))
    by_category = best_match(asked, targets, keys).select(*keys, "name", F.col("target_id").alias("category_id"))
    hit = asked.join(by_category, [*keys, "name"], "left")
    by_benefit = match_benefits(hit.where("category_id is null"), benefits, keys).select(*keys, "name", "benefit_id")
    hit = hit.join(by_benefit, [*keys, "name"], "left").withColumn("benefit_id", F.when(F.col("category_id").isNull(), F.col("benefit_id")))
    links = hit.where("category_id is not null or benefit_id is not null").select(*keys, "share_id", "category_id", "benefit_id").distinct()
    unlinked = _issues(hit.where("category_id is null and benefit_id is null"), keys, "unlinked_cost_share", "warning")
    silent = _issues(r.where("coalesce(applies_to, '') = ''"), keys, "unlinked_cost_share", "info")
    return links, unlinked.unionByName(silent)
