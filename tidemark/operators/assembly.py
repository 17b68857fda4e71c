"""Extracted rows to entities: ranked de-duplication, fuzzy links, grounding of quotes, corrections, issues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.streams import codes
from ..functions.text import names_match, normal_scores, normalize_text, scored, scored1
from ..sources.scratch import Scratch, checkpointed


def dedupe_ranked(df: DataFrame, identity: list[str], rank: list[Column]) -> DataFrame:
    """One row of each identity, the first by ``rank``."""
    w = Window.partitionBy(*identity).orderBy(*rank)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


_names_match = scored(names_match)
_normal = scored1(normalize_text)


def link_names(names: DataFrame, name: str, targets: list[str], least: float) -> DataFrame:
    """(name, target, score): for each distinct name the target most alike, if alike enough; ties by target.

    Targets are a plan's few names; they go with the query as a literal.
    """
    each = names.select(name).distinct().select(name, F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    score = each.withColumn("score", F.round(_names_match(F.col(name), F.col("target")), 3))
    w = Window.partitionBy(name).orderBy(F.desc("score"), "target")
    return score.withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) & (F.col("score") >= least)).drop("__n")


def _bits(text: str) -> np.ndarray:
    """Numbers below 2^16 of a text's runs of three characters; different runs may share one."""
    of = codes(text).astype(np.uint32)
    mixed = (of[:-2] * np.uint32(0x9E3779B1)) ^ (of[1:-1] * np.uint32(0x85EBCA77)) ^ (of[2:] * np.uint32(0xC2B2AE3D))
    return (mixed >> np.uint32(16)).astype(np.int64)


def _shared(pages: DataFrame, blocks: DataFrame, group: str, kinds: str, least: float) -> DataFrame:
    """(group, block, quote_id, page, shared, n, short, inside, mine): for each page and quote of a group how many of the quote's
    runs the page has, or a few more, and whether it has the quote; pages that cannot score ``least`` (``may_reach``) only if the
    quote is said to be from them. A block's runs are made once for the pages that follow one another."""
    r = (least - 0.001) / 100
    names = [group, "block", "quote_id", "page", "shared", "n", "short", "inside", "mine"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}
        for pdf in frames:
            out = []
            for g, block, page, text, ids, texts, owns in pdf[[group, "block", "page", "t", "ids", "texts", "owns"]].itertuples(index=False):
                if g != now:
                    now, held = g, {}
                if block not in held:
                    runs = [_bits(q) for q in texts]
                    n = np.array([len(q) for q in texts])
                    lost = np.floor(5 * (1 - r) * n + max(0.0, 2.5 * r - 2) * n * (1 - r) / (1 - r / 2) + 1e-9)
                    ends = np.cumsum([len(x) for x in runs])
                    held[block] = np.concatenate(runs), ends - [len(x) for x in runs], ends, n, n - 2 - lost
                of, starts, ends, n, need = held[block]
                have = np.zeros(1 << 16, bool)
                have[_bits(text)] = True
                seen = np.concatenate([[0], np.cumsum(have[of])])
                shared = seen[ends] - seen[starts]
                mine = np.array([o is not None and o == page for o in owns])
                for k in np.flatnonzero(mine | (n > len(text)) | (shared >= need)).tolist():
                    inside = bool(shared[k] >= n[k] - 2) and texts[k] in text
                    out.append((g, block, ids[k], page, shared[k], n[k], n[k] > len(text), inside, mine[k]))
            yield pd.DataFrame(out, columns=names)

    return pages.join(blocks, group).mapInPandas(run, f"{kinds}, shared bigint, n bigint, short boolean, inside boolean, mine boolean")


def _scores(pairs: DataFrame, pages: DataFrame, quotes: DataFrame, group: str, kinds: str) -> DataFrame:
    """``pairs`` (group, block, quote_id, page, floor) with their score, 0 if it is not above the floor; a page's text goes once
    to each block of its quotes."""
    asked = pairs.join(quotes.select("quote_id", "q"), "quote_id").groupBy(group, "block", "page").agg(F.collect_list("quote_id").alias("ids"), F.collect_list("q").alias("texts"), F.collect_list("floor").alias("floors"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pairs = [
                (g, block, i, page, q, text, floor)
                for g, block, page, text, ids, texts, floors in pdf[[group, "block", "page", "t", "ids", "texts", "floors"]].itertuples(index=False)
                for i, q, floor in zip(ids, texts, floors)
            ]
            scores = normal_scores([x[4] for x in pairs], [x[5] for x in pairs], [x[6] for x in pairs])
            rows = [(*x[:4], round(score, 3)) for x, score in zip(pairs, scores)]
            yield pd.DataFrame(rows, columns=[group, "block", "quote_id", "page", "score"])

    return asked.join(pages, [group, "page"]).mapInPandas(run, f"{kinds}, score double")


def ground_quotes(quotes: DataFrame, pages: DataFrame, group: str, cited: str | None = None, least: float = 85.0, block: int = 500) -> DataFrame:
    """(quote_id, page, score): the page of the quote's group on which it is found, as far as one scores ``least``; of several the
    best, ties by page. ``cited`` names a column of pages that quotes say they are from: that page is scored whatever comes
    out and stays if it scores ``least``, or if no other page does. A quote without words, and one that no page reaches, has
    a null page and score 0, or its cited page's score.

    Both sides are brought into normal form once; a page meets the quotes of its group in blocks. First runs of three
    characters are counted for all, and pages that cannot score ``least`` by them left out; then each quote is scored on its cited page and the one that shares most, and only
    after that on those others that share as many as it takes to do as well (``may_reach``), each as far as it takes to know
    whether it does. Nothing is left out by that.
    """
    page_kind = pages.schema["page"].dataType.simpleString()
    kinds = f"`{group}` {pages.schema[group].dataType.simpleString()}, block int, quote_id {quotes.schema['quote_id'].dataType.simpleString()}, page {page_kind}"
    own = F.lit(None).cast(page_kind) if cited is None else F.col(cited).cast(page_kind)
    with Scratch(quotes.sparkSession) as kept:
        n = quotes.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        part = F.pmod(F.xxhash64("quote_id"), F.col("blocks")).cast("int").alias("block")
        q = quotes.select(group, "quote_id", _normal("quote").alias("q"), own.alias("own")).where("q <> ''")
        q = kept.keep(q.join(n, group).select(group, "quote_id", "q", "own", part))
        p = kept.keep(pages.where("text is not null").select(group, "page", _normal("text").alias("t")).where("t <> ''"))
        entry = F.struct("quote_id", "q", "own")
        blocks = q.groupBy(group, "block").agg(F.collect_list(entry).alias("e"))
        blocks = blocks.select(group, "block", F.col("e.quote_id").alias("ids"), F.col("e.q").alias("texts"), F.col("e.own").alias("owns"))
        met = kept.keep(_shared(p, blocks, group, kinds, least))
        # the page with the quote, or most of it, and the cited page where that has not all of it
        top = met.groupBy("quote_id").agg(F.min_by(F.struct("page", "inside"), F.struct(~F.col("inside"), -F.col("shared"), "page")).alias("top"))
        top = kept.keep(top.select("quote_id", F.col("top.page").alias("first"), F.col("top.inside").alias("sure")))
        named = met.join(top, "quote_id")
        found = named.where("inside and (mine or page = first)").select("quote_id", "page", F.lit(100.0).alias("score"), "mine")
        pair = [group, "block", "quote_id", "page"]
        low = F.lit(least - 0.001).alias("floor")  # scores are rounded
        first = kept.keep(_scores(named.where("not inside and (mine or page = first)").select(*pair, low), p, q, group, kinds))
        tried = kept.keep(found.unionByName(first.join(met.select("quote_id", "page", "mine"), ["quote_id", "page"]).select("quote_id", "page", "score", "mine")))
        # what another page must score to count: nothing does if the cited page will do, or a page has the whole quote
        state = tried.groupBy("quote_id").agg(F.max("score").alias("best"), F.max(F.when(F.col("mine"), F.col("score"))).alias("mine_score"))
        open_ = state.where((F.col("best") < 100) & (F.coalesce("mine_score", F.lit(0.0)) < least)).select("quote_id", (F.greatest(F.lit(least), F.col("best")) - 0.001).alias("floor"))
        r = F.col("floor") / 100
        lost = F.floor(5 * (1 - r) * F.col("n") + F.greatest(F.lit(0.0), 2.5 * r - 2) * F.col("n") * (1 - r) / (1 - r / 2) + 1e-9)
        reach = F.col("short") | (F.col("shared") >= F.col("n") - 2 - lost)
        others = named.join(open_, "quote_id").where(reach & ~F.col("mine") & (F.col("page") != F.col("first"))).select(*pair, "floor")
        more = _scores(others, p, q, group, kinds).select("quote_id", "page", "score", F.lit(False).alias("mine"))
        done = kept.keep(tried.unionByName(more).where(F.col("score") >= least))
        # quotes that no page has keep their cited page with what it scores
        none = named.where("mine").join(done.select("quote_id").distinct(), "quote_id", "left_anti").select(*pair, F.lit(0.0).alias("floor"))
        rest = _scores(none, p, q, group, kinds).select("quote_id", "page", "score", F.lit(True).alias("mine"))
        # the cited page if it will do, else the best
        best = done.unionByName(rest).groupBy("quote_id").agg(F.min_by(F.struct("page", "score"), F.struct(~F.col("mine"), -F.col("score"), "page")).alias("b"))
        out = quotes.select("quote_id").join(best, "quote_id", "left").select("quote_id", "b.page", F.coalesce("b.score", F.lit(0.0)).alias("score"))
        return checkpointed(out)


#: What a verifier's verdict leaves of a quote's score.
VERDICT_FACTORS = {"supported": 1.0, "corrected": 0.85, "unsupported": 0.35}


def row_confidence(score: Column, verdict: Column, grounded: Column, exhausted: Column) -> Column:
    """Score by verdict (.75 without one), .5 at most without a ground, a tenth less when tries ran out; in decimals,
    so that ties round up.
    """
    exact = lambda x, kind: F.lit(str(x)).cast(kind)
    factor = F.coalesce(*[F.when(verdict == v, exact(f, "decimal(3,2)")) for v, f in VERDICT_FACTORS.items()], exact(0.75, "decimal(3,2)"))
    c = score.cast("decimal(6,3)") * factor * exact("0.01", "decimal(3,2)")
    c = F.when(grounded, c).otherwise(F.least(c, exact(0.5, "decimal(3,2)")))
    return F.round(c * F.when(exhausted, exact(0.9, "decimal(3,2)")).otherwise(exact(1, "decimal(3,2)")), 3).cast("double")


#: The score from which a quote has a ground, and the confidence below which a row is to be looked at.
GROUNDED_SCORE, LOW_CONFIDENCE = 85.0, 0.6


def judge_rows(rows: DataFrame, verdicts: DataFrame, pages: DataFrame, exhausted: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with verdict, confidence and ground, and issues (row_id, page, code, severity).

    ``rows`` (row_id, page, score of the quote on its page), ``verdicts`` (row_id, verdict, last one wins by ``place``),
    ``pages`` (page) of the chunk. Rows of other pages are dropped and told of. Of the rest each has one issue at most:
    the verifier's, else a missing ground, else low confidence.
    """
    said = verdicts.groupBy("row_id").agg(F.max_by("verdict", "place").alias("verdict"))
    known = rows.join(pages.select("page").distinct(), "page", "left_semi").join(said, "row_id", "left")
    grounded = F.col("score") >= GROUNDED_SCORE
    out = known.withColumns({"grounded": grounded, "confidence": row_confidence(F.col("score"), F.col("verdict"), grounded, exhausted)})
    outside = rows.join(pages.select("page").distinct(), "page", "left_anti").select("row_id", "page", F.lit("unsupported_row").alias("code"), F.lit("warning").alias("severity"))
    code = F.when(F.col("verdict") == "unsupported", "unsupported_row").when(~F.col("grounded"), "ungrounded_quote").when(F.col("confidence") < LOW_CONFIDENCE, "low_confidence")
    told = out.withColumn("code", code).where("code is not null")
    severity = F.when(F.col("code") == "low_confidence", "info").otherwise("warning")
    return out, outside.unionByName(told.select("row_id", "page", "code", severity.alias("severity")))


def apply_corrections(df: DataFrame, patch: str, allowed: dict[str, str]) -> DataFrame:
    """Columns replaced by what a JSON object names, if allowed and readable as the column's type."""
    values = F.from_json(patch, "map<string,string>")
    return df.withColumns({c: F.coalesce(values[c].try_cast(t), F.col(c)) for c, t in allowed.items()})


def merge_issues(*issues: DataFrame, order: str) -> DataFrame:
    """Issues (code, page, category, row_id, message, ``order``) by all but the order, each once, for those of code
    ``pii_advisory`` whatever the message: the first by list, then by ``order``."""
    every = None
    for i, x in enumerate(issues):
        one = x.withColumn("__list", F.lit(i))
        every = one if every is None else every.unionByName(one)
    text = F.when(F.col("code") != "pii_advisory", F.col("message")).otherwise("")
    w = Window.partitionBy("code", "page", "category", "row_id", text).orderBy("__list", order)
    return every.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__list")


def duplicate_issues(rows: DataFrame, kept_by: DataFrame, key: str, page: str) -> DataFrame:
    """(page, removed, code, severity): how many rows of each page a duplicate search (key, kept_by) left out for another."""
    gone = rows.join(kept_by.where(F.col("kept_by") != F.col(key)).select(key), key, "left_semi")
    return gone.groupBy(page).agg(F.count("*").alias("removed")).select(page, "removed", F.lit("duplicate_removed").alias("code"), F.lit("info").alias("severity"))


def unique_ids(df: DataFrame, base: str, order: list[str], out: str = "id") -> DataFrame:
    """Ids of a base name, with -2, -3, ... after the first."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", base, n.cast("string"))))


def page_windows(df: DataFrame, key: str, pages: str, size: int = 5, overlap: int = 1) -> DataFrame:
    """(key, window, first, last): windows of ``size`` pages that share ``overlap``, until the last page is in one."""
    step = size - overlap
    starts = F.when(F.col(pages) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.col(pages) - overlap), F.lit(step)))
    return df.select(key, pages, F.posexplode(starts).alias("window", "first")).select(
        key, "window", "first", F.least(F.col("first") + (size - 1), F.col(pages)).alias("last")
    )


def uncovered(df: DataFrame, covered: DataFrame, key: str, last: str, block: int = 65_536) -> DataFrame:
    """(key, page): pages 1 to ``last`` that ``covered`` (key, page) lacks.

    A key's pages are made block by block, so that no row holds all of them and blocks spread over tasks.
    """
    n = F.col(last).cast("bigint")
    blocks = df.select(key, n.alias("__last"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.greatest(n, F.lit(1)) - 1) / block))).alias("__b"))
    blocks = blocks.where("__last > 0").repartition(key, "__b")
    low = F.col("__b") * block + 1
    pages = blocks.select(key, F.explode(F.sequence(low, F.least(low + (block - 1), F.col("__last")))).alias("page"))
    return pages.join(covered.select(key, F.col("page").cast("bigint").alias("page")), [key, "page"], "left_anti")


def batches(df: DataFrame, group: str, order: str, size: str, most_items: int, most_size: int) -> DataFrame:
    """Adds ``batch``: rows in order are put in a batch as long as count and size allow."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, total, batch, out = 0, 0, 0, []
        pdf = pdf.sort_values(order)
        for s in pdf[size]:
            if n and (n >= most_items or total + s > most_size):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + s
            out.append(batch)
        return pdf.assign(batch=pd.array(out, "int32"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(group).applyInPandas(run, f"{fields}, batch int")


def explode_plan(plans: DataFrame) -> DataFrame:
    """Rows (plan_id, category_name, benefit_name, percent, limit_dollars, keywords) of nested plans: what assembly took."""
    c = plans.select("plan_id", F.explode("categories").alias("c"))
    b = c.select("plan_id", F.col("c.name").alias("category_name"), F.explode("c.benefits").alias("b"))
    return b.select(
        "plan_id", "category_name", F.col("b.name").alias("benefit_name"), F.col("b.percent").alias("percent"),
        (F.col("b.limit_cents") / 100).alias("limit_dollars"), F.concat_ws(", ", "b.keywords").alias("keywords"),
    )


def assemble_plan(rows: DataFrame) -> DataFrame:
    """Nested plans (plan_id, categories) from such rows, categories and benefits by name."""
    from ..functions.money import dollars_to_cents

    keywords = F.filter(F.transform(F.split("keywords", ","), lambda k: F.trim(k)), lambda k: k != "")
    benefit = F.struct(F.col("benefit_name").alias("name"), "percent", dollars_to_cents(F.col("limit_dollars")).alias("limit_cents"), keywords.alias("keywords"))
    c = rows.groupBy("plan_id", "category_name").agg(F.sort_array(F.collect_list(benefit)).alias("benefits"))
    category = F.struct(F.col("category_name").alias("name"), "benefits")
    return c.groupBy("plan_id").agg(F.sort_array(F.collect_list(category)).alias("categories"))
