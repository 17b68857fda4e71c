"""Evaluation: greedy one-to-one matching, rates, gates, contamination by shared word runs."""

from __future__ import annotations

from collections import Counter, deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prose import altered_quotes, plain_quote
from ..functions.text import ratio, scored, token_set_ratio, token_sort_ratio
from .joins import bounded
from .rules import resolve_citations


#: Likeness from which rows match, and from which a field is right; fields that are compared loosely, and
#: those that are lists.
MATCH_SCORE, FIELD_SCORE = 80.0, 90.0
FUZZY_FIELDS = ("insurer", "plan_name", "category_name", "benefit_name", "pool_name", "name")
LIST_FIELDS = ("item_codes", "benefit_names", "applies_to")


def plain_name(text: str | None) -> str:
    return " ".join((text or "").lower().replace("&", "and").split())


class _Names:
    """Distinct names that may be taken, to be asked for those that can be like another one."""

    def __init__(self, names: list[str]):
        self.names = names
        self.with_word: dict[str, list[int]] = {}
        for j, name in enumerate(names):
            for word in set(name.split()):
                self.with_word.setdefault(word, []).append(j)
        self.number: dict[str, int] = {}
        plain = [" ".join(sorted(set(n.split()))) for n in names]
        for text in plain:
            for c in text:
                self.number.setdefault(c, len(self.number))
        self.sizes = np.array([len(t) for t in plain], np.int64)
        self.counts = np.zeros((len(self.number), len(names)), np.int32)
        for j, text in enumerate(plain):
            for c, many in Counter(text).items():
                self.counts[self.number[c], j] = many

    def sharing(self, name: str) -> set[int]:
        """Places of names that share a word: only such ones can score 100."""
        return set().union(*(self.with_word.get(w, ()) for w in set(name.split())))

    def near(self, name: str, least: float) -> set[int]:
        """Places of other names that may score ``least``: without a common word the score is the ratio of all words, in order,
        which takes as many common characters, whatever their order."""
        text = " ".join(sorted(set(name.split())))
        shared = np.zeros(len(self.names), np.int32)
        for c, many in Counter(text).items():
            if c in self.number:
                shared += np.minimum(self.counts[self.number[c]], many)
        return set(np.flatnonzero(200.0 * shared >= (least - 1e-9) * np.maximum(self.sizes + len(text), 1)).tolist())


def greedy_match(golden: DataFrame, predicted: DataFrame, group: str, threshold: float = MATCH_SCORE, kind: str | None = None) -> DataFrame:
    """(group, golden_id, predicted_id, score): each golden row, in order of id, takes the most alike predicted row
    that is left, the first of equals; rows without a partner on either side have a null. Both: (group, id, name), and
    ``kind``, if named, which must be equal. Only distinct names are scored, and of those only such as can reach the
    threshold; rows of one group and kind, which take from one another, meet in one frame.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows_of = lambda df: sorted(zip(df["id"], df["name"].map(plain_name))) if len(df) else []
        same: dict[str, list[int]] = {}
        for i, name in rows_of(right):
            same.setdefault(name, []).append(i)
        left_over = {name: deque(ids) for name, ids in same.items()}
        names = _Names(list(same))
        scores: dict[tuple[str, bool], list[tuple[float, str]]] = {}
        rows = []
        key = (left if len(left) else right)[group].iloc[0]

        def scored_by(name: str, whole: bool) -> list[tuple[float, str]]:
            """Scores from the threshold on, the best first: all, or those of 100 alone."""
            if (name, whole) not in scores:
                near = names.sharing(name)
                if not whole:
                    near = near | names.near(name, threshold) if threshold > 0 else range(len(names.names))
                known = [(token_set_ratio(name, names.names[j]), names.names[j]) for j in near]
                scores[name, whole] = sorted((x for x in known if x[0] >= (100.0 if whole else threshold)), key=lambda x: -x[0])
            return scores[name, whole]

        for i, name in rows_of(left):
            best = None
            for whole in (True, False):
                for score, other in scored_by(name, whole) if best is None and (whole or threshold < 100) else ():
                    if best and score < best[0]:
                        break
                    ids = left_over[other]
                    if ids and (best is None or ids[0] < best[1]):
                        best = (score, ids[0], other)
            if best:
                left_over[best[2]].popleft()
                rows.append((key, i, best[1], best[0]))
            else:
                rows.append((key, i, None, None))
        rows += [(key, None, i, None) for i in sorted(i for ids in left_over.values() for i in ids)]
        out = pd.DataFrame(rows, columns=[group, "golden_id", "predicted_id", "score"])
        return out.astype({"golden_id": "Int64", "predicted_id": "Int64", "score": "Float64"})

    by = golden.schema[group].dataType.simpleString()
    schema = f"{group} {by}, golden_id bigint, predicted_id bigint, score double"
    names = [group, "id", "name", *([kind] if kind else [])]
    # fresh columns, as both sides may stem from one table
    a, b = (df.select(*[F.col(c).alias(c) for c in names]).groupBy(group, *([kind] if kind else [])) for df in (golden, predicted))
    return a.cogroup(b).applyInPandas(run, schema)


def accuracy(matches: DataFrame, group: str) -> DataFrame:
    """(group, correct, total, accuracy): rows unmatched on either side count in the total."""
    ok = F.col("golden_id").isNotNull() & F.col("predicted_id").isNotNull()
    return matches.groupBy(group).agg(
        F.count_if(ok).alias("correct"), F.count("*").alias("total"), (F.count_if(ok) / F.count("*")).alias("accuracy")
    )


def _list_parts(text: str | None) -> list[str]:
    return sorted(x for x in (p.strip() for p in plain_name(text).split(",")) if x)


def _alike_lists(a: str | None, b: str | None) -> float:
    """100 if both lists are as long and each part of the first is like one of the second."""
    x, y = _list_parts(a), _list_parts(b)
    return 100.0 if len(x) == len(y) and all(any(ratio(p, q) >= FIELD_SCORE for q in y) for p in x) else 0.0


_loose = scored(lambda a, b: token_sort_ratio(plain_name(a), plain_name(b)))
_lists = scored(_alike_lists)


def field_right(name: str, kind: str, golden: Column, predicted: Column) -> Column:
    """Whether a field is as it should be: numbers to half a cent, names loosely, lists part by part, other texts but for case
    and spaces; null on one side alone is wrong."""
    if kind in ("double", "float", "int", "bigint") or kind.startswith("decimal"):
        same = F.abs(golden.cast("double") - predicted.cast("double")) <= 0.005
    elif kind == "boolean":
        same = golden == predicted
    elif name in LIST_FIELDS:
        same = _lists(golden, predicted) == 100.0
    elif name in FUZZY_FIELDS:
        same = _loose(golden, predicted) >= FIELD_SCORE
    else:
        plain = lambda c: F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit("and")), r"\s+", " "))
        same = plain(golden) == plain(predicted)
    return golden.isNotNull() & predicted.isNotNull() & same


def field_accuracy(golden: DataFrame, predicted: DataFrame, matches: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, correct, total, accuracy) over the fields of matched rows, but for those that both lack; all that an unmatched
    row has, on either side, counts as wrong."""
    a = golden.select(F.col(group).alias(group), F.col("id").alias("golden_id"), *[F.col(f).alias(f"a_{f}") for f in fields])
    b = predicted.select(F.col(group).alias(group), F.col("id").alias("predicted_id"), *[F.col(f).alias(f"b_{f}") for f in fields])
    rows = matches.join(a, [group, "golden_id"], "left").join(b, [group, "predicted_id"], "left")
    kinds = {f: golden.schema[f].dataType.simpleString() for f in fields}
    right = {f: field_right(f, kinds[f], F.col(f"a_{f}"), F.col(f"b_{f}")) for f in fields}
    rows = rows.withColumns({f"ok_{f}": F.coalesce(c, F.lit(False)) for f, c in right.items()})
    many = sum(((F.col(f"a_{f}").isNotNull() | F.col(f"b_{f}").isNotNull()).cast("int") for f in fields), F.lit(0))
    good = sum((F.col(f"ok_{f}").cast("int") for f in fields), F.lit(0))
    per = rows.groupBy(group).agg(F.sum(good).alias("correct"), F.sum(many).alias("total"))
    return per.select(group, "correct", "total", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)).alias("accuracy"))


def gate(value: Column, low: Column, high: Column, required: Column) -> Column:
    """``fail`` for a missing required value or one outside its bounds, ``skipped`` for another missing one, else ``pass``."""
    outside = F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))
    return (
        F.when(value.isNull(), F.when(required, "fail").otherwise("skipped"))
        .when(outside, "fail").otherwise("pass")
    )


def gate_summary(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, value, status) for each threshold (metric, low, high, required)."""
    joined = thresholds.join(metrics, "metric", "left")
    return joined.select("metric", "value", gate(F.col("value"), F.col("low"), F.col("high"), F.col("required")).alias("status"))


def judge_citations(answers: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, citations, unknown, link_only, licence, attribution, overrun, altered, expected_hit, passed) for each answer.

    ``answers`` (id, response, context, expected array), ``citations`` (id, ref, licence or null, attribution), ``sources``
    (source_id, url, index, licence, verbatim). A citation counts as unknown, of a source that is only linked, of another
    licence than its source's, or without attribution; an answer overruns if it cites a source of excerpts and shares more
    words in a row with its context than an excerpt may, and alters quotes if it cites one that must be quoted as it is.
    It passes if it cites at all and nothing of that counts.
    """
    s = sources.select(F.col("source_id").alias("__s"), "index", F.col("licence").alias("__licence"), "verbatim")
    found = resolve_citations(citations, sources).join(s, F.col("source_id") == F.col("__s"), "left")
    known, yes = F.col("__s").isNotNull(), lambda c: F.coalesce(c, F.lit(False))
    other = F.col("licence").isNotNull() & (plain_quote(F.col("licence")) != plain_quote(F.col("__licence")))
    per = found.groupBy("id").agg(
        F.count("*").alias("citations"), F.count_if(~known).alias("unknown"), F.count_if(known & ~yes(F.col("index"))).alias("link_only"), F.count_if(known & other).alias("licence"),
        F.count_if(known & (F.trim(F.coalesce("attribution", F.lit(""))) == "")).alias("attribution"), F.bool_or(known & ~yes(F.col("verbatim"))).alias("__excerpt"),
        F.bool_or(known & yes(F.col("verbatim"))).alias("__verbatim"), F.collect_set("__s").alias("__cited"),
    )
    runs = lambda c: word_runs(F.coalesce(c, F.lit("")), EXCERPT_WORDS + 1)
    told = F.trim(F.coalesce("context", F.lit(""))) != ""
    rows = answers.join(per, "id", "left")
    rows = rows.withColumns(
        {"overrun": told & yes(F.col("__excerpt")) & F.arrays_overlap(runs("response"), runs("context")),
         "altered": F.when(told & yes(F.col("__verbatim")), F.size(altered_quotes(F.col("response"), F.col("context")))).otherwise(0)}
    )
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("citations", "unknown", "link_only", "licence", "attribution")]
    out = rows.select("id", *counts, F.coalesce("overrun", F.lit(False)).alias("overrun"), "altered", F.coalesce(F.arrays_overlap("__cited", "expected"), F.lit(False)).alias("expected_hit"))
    clean = F.col("unknown") + F.col("link_only") + F.col("licence") + F.col("attribution") + F.col("altered") == 0
    return out.withColumn("passed", (F.col("citations") > 0) & clean & ~F.col("overrun"))


def citation_rates(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, pass_rate, expected_rate): shares of answers whose citations passed, and that cite the expected source;
    null flags count as not."""
    yes = lambda c: F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0))
    return results.groupBy(*keys).agg(F.count("*").alias("rows"), yes(F.col("passed")).alias("pass_rate"), yes(F.col("expected_hit")).alias("expected_rate"))


#: The class of words in which runs are counted, and the longest run that an excerpt may share.
WORD = "[a-z0-9']+"
EXCERPT_WORDS = 50


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def word_runs(text: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words of a text."""
    hashed = F.transform(words(text), lambda x: F.xxhash64(x))
    n = F.size(hashed) - size + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(hashed, i, size)))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def grams(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, gram): the distinct runs of ``size`` words, hashed.

    Hashes of runs of one, two, four and on words are made from one another, and those of ``size`` from the ones that add up
    to it, so that a place costs as many hashes as the size has bits and not as it has words.
    """
    hashed = F.transform(words(F.col("text")), lambda x: F.xxhash64(x))
    rows = df.select(key, hashed.alias("w")).where(F.size("w") >= size).withColumn("p", F.col("w"))
    joined = lambda a, b, by: F.zip_with(a, F.slice(b, by + 1, F.size(b)), lambda x, y: F.xxhash64(x, y))
    have, power, bits = 0, 1, size
    while bits:
        if bits & 1:
            rows = rows.withColumn("run", joined("run", "p", have) if have else F.col("p"))
            have += power
        bits >>= 1
        if bits:
            rows = rows.withColumn("p", joined("p", "p", power))
            power *= 2
    whole = F.slice("run", 1, F.size("w") - (size - 1))
    return rows.select(key, F.explode(F.array_distinct(whole)).alias("gram"))


def overruns(docs: DataFrame, excerpts: DataFrame, most: int = EXCERPT_WORDS) -> DataFrame:
    """(doc_id, item_id, shared): documents that share more than ``most`` words in a row with an excerpt, and in how
    many places of it: an equality join on runs of ``most`` + 1 words. Runs of the excerpts, if they are few, go to the
    documents, so that only what both have is shuffled.
    """
    a, b = grams(docs, "doc_id", most + 1), grams(excerpts, "item_id", most + 1)
    return a.join(bounded(b), "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
