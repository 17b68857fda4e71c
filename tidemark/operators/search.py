"""Keyword, fielded, vector and hybrid search."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that searches in a plan ignore, and those that the substring search does.
STOP_WORDS = (
    "item", "items", "number", "no", "code", "for", "the", "a", "an", "my", "of", "and", "is", "are", "do", "i", "how", "much", "what", "does",
)
SUBSTRING_STOP_WORDS = ("the", "and", "for", "what", "does", "can", "how", "are", "with", "that", "this", "your", "you", "is")
#: The classes of terms of the searches over knowledge, and over plans.
KNOWLEDGE_TERM = "[a-z]{3,}"
PLAN_TERM = r"[\p{L}\p{N}_'-]+"


def terms(text: Column) -> Column:
    """Distinct runs of three or more ASCII letters, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(KNOWLEDGE_TERM), 0))


def plan_terms(text: Column) -> Column:
    """Words of a plan's text in lower case, apostrophes and hyphens inside, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PLAN_TERM), 0)
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def asked(query: str) -> list[str]:
    """The same of a query, each word once."""
    return list(dict.fromkeys(w for w in re.findall(r"[\w'-]+", query.lower()) if w not in STOP_WORDS))


def top_k(df: DataFrame, query: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each query, ties by ``tie``, with their rank."""
    w = Window.partitionBy(query).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def overlap_search(queries: DataFrame, docs: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """(query_id, doc_id, hits, size, score, rank): shared terms over the query's terms, best k of the same region; ties by
    id, and documents that share nothing where too few do.

    ``queries`` (query_id, text, region or not), ``docs`` (doc_id, text, region or not). Queries are taken in blocks of
    about ``block``, each against all documents; a task keeps k candidates a query, so that neither a common term's
    postings nor pairs of queries and documents are shuffled.
    """
    by_region = "region" in queries.columns and "region" in docs.columns
    region = lambda df: (F.col("region").cast("string") if by_region else F.lit("")).alias("region")
    q = queries.select("query_id", region(queries), terms(F.col("text")).alias("t"))
    d = docs.select("doc_id", region(docs), "text")
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((q, "query_id"), (d, "doc_id"))}
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, hits bigint, size bigint, score double"
    many = max(1, -(-queries.count() // block))
    sc, out = docs.sparkSession.sparkContext, None
    for part in range(many):
        own = q if many == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(many)) == part)
        shared = sc.broadcast([(r[0], r[1], list(r[2] or ())) for r in own.collect()])  # about ``block`` rows

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            asked_for = shared.value
            postings: dict[str, list[int]] = {}
            for i, (_, _, ts) in enumerate(asked_for):
                for t in ts:
                    postings.setdefault(t, []).append(i)
            postings = {t: np.array(v) for t, v in postings.items()}
            regions = {r: np.array([i for i, x in enumerate(asked_for) if x[1] == r]) for r in {x[1] for x in asked_for}}
            word = re.compile(KNOWLEDGE_TERM)
            best: list[list[tuple[int, object]]] = [[] for _ in asked_for]  # (-hits, id), sorted
            # of each query the last of its k best: what a document must beat, which is seen for all queries at once
            least, last = np.full(len(asked_for), -1), np.zeros(len(asked_for), object)
            none = np.zeros(len(asked_for), np.int64)
            for pdf in frames:
                for doc, where, text in zip(pdf["doc_id"].tolist(), pdf["region"], pdf["text"]):
                    places = regions.get(where)
                    if places is None:
                        continue
                    found = [postings[t] for t in set(word.findall((text or "").lower())) if t in postings]
                    hits = np.bincount(np.concatenate(found), minlength=len(asked_for)) if found else none
                    own, bar = hits[places], least[places]
                    wins = own > bar
                    if (ties := np.flatnonzero(own == bar)).size:
                        wins[ties] = doc < last[places[ties]]
                    for i in places[wins].tolist():
                        mine = best[i]
                        bisect.insort(mine, (-int(hits[i]), doc))
                        del mine[k:]
                        if len(mine) == k:
                            least[i], last[i] = -mine[-1][0], mine[-1][1]
            rows = [(asked_for[i][0], doc, -h, len(asked_for[i][2]), -h / max(1, len(asked_for[i][2]))) for i, own in enumerate(best) for h, doc in own]
            yield pd.DataFrame(rows, columns=["query_id", "doc_id", "hits", "size", "score"])

        got = d.mapInPandas(run, schema)
        out = got if out is None else out.unionByName(got)
    return top_k(out, "query_id", "score", "doc_id", k)


def substring_search(docs: DataFrame, query: str, region: str | None = None, k: int = 3) -> DataFrame:
    """(doc_id, score, reranked): how many terms of the query occur anywhere in title and content, of the region's
    documents; the best, three at most, by the whole count and then id; ``reranked`` is the count up to 4."""
    found = [w for w in dict.fromkeys(re.findall(KNOWLEDGE_TERM, query.lower())) if w not in SUBSTRING_STOP_WORDS]
    own = docs if region is None else docs.where(F.col("region") == region)
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "content") if c in docs.columns]))
    score = sum((F.contains(hay, F.lit(w)).cast("bigint") for w in found), F.lit(0).cast("bigint"))
    scored = own.select("doc_id", score.alias("score")).withColumn("reranked", F.least(F.lit(4), "score").cast("bigint"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(max(1, min(k, 3)))


def _begins(words: Column, head: str) -> Column:
    return F.exists(words, lambda x: x.startswith(head))


def fielded_search(df: DataFrame, fields: dict[str, float], query: str, key: str, k: int) -> DataFrame:
    """(key, score): for each query word the best field that has it, a word's beginning, from two letters on, at half
    weight; the best k."""
    total = F.lit(0.0)
    for w in asked(query):
        per = []
        for name, boost in fields.items():
            words = plan_terms(F.col(name))
            begins = _begins(words, w) if len(w) >= 2 else F.lit(False)
            per.append(F.when(F.array_contains(words, w), boost).when(begins, boost / 2).otherwise(0.0))
        total = total + (F.greatest(*per) if len(per) > 1 else per[0])
    scored = df.select(key, total.alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), key).limit(k)


def bm25_search(docs: DataFrame, fields: dict[str, float], query: str, key: str, k: int, fuzzy: float = 0.2,
                prefix_from: int = 2, fuzzy_from: int = 4) -> DataFrame:
    """(key, score): BM25 over boosted fields, with prefixes (words of ``prefix_from`` letters or more) and near spellings
    (of ``fuzzy_from``, none with digits) of query words; any word may match.
    """
    wanted = asked(query)
    post = None
    for name, boost in fields.items():
        words = plan_terms(F.col(name))
        one = docs.select(key, F.lit(boost).alias("boost"), F.explode(words).alias("term"))
        post = one if post is None else post.unionByName(one)
    tf = post.groupBy(key, "term").agg(F.sum("boost").alias("tf"))
    n = docs.count()
    forms = []
    for w in wanted:
        same, head = F.col("term") == w, F.col("term").startswith(w)
        spelt = len(w) >= fuzzy_from and not any(c.isdigit() for c in w)
        near = F.levenshtein("term", F.lit(w)) <= round(fuzzy * len(w)) if spelt else F.lit(False)
        forms.append(F.when(same, 1.0).when(head if len(w) >= prefix_from else F.lit(False), 0.375).when(near, 0.45).otherwise(0.0))
    weight = F.greatest(*forms, F.lit(0.0)) if forms else F.lit(0.0)
    hits = tf.withColumn("w", weight).where("w > 0")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = hits.join(df, "term").groupBy(key).agg(F.round(F.sum(F.col("w") * idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2)), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, score, rank): cosine, best k for each query, the query itself apart.

    Queries are taken in blocks of ``block``; each task keeps k candidates a query, so that what is shuffled grows with
    tasks and queries alone.
    """
    spark, out = vectors.sparkSession, None
    many = queries.count()
    blocks = max(1, -(-many // block))
    for part in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == part)
        rows = own.select("vec_id", "embedding").collect()  # about ``block`` rows
        ids = np.array([r[0] for r in rows], np.int64)
        matrix = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            yield from _nearest(*shared.value, frames, k)

        got = vectors.select("vec_id", "embedding").mapInPandas(run, "query_id bigint, vec_id bigint, score double")
        out = got if out is None else out.unionByName(got)
    return top_k(out, "query_id", "score", "vec_id", k)


#: About how many scores are held at once.
SCORES = 1 << 21


def _nearest(qid: np.ndarray, q: np.ndarray, frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """(query_id, vec_id, score): the best k of all frames for each query, of a few vectors at a time; what is under a query's
    best k so far is let go at once."""
    best: list[pd.DataFrame] = []
    floor, held, step = np.full(len(qid), -np.inf), 0, max(64, SCORES // max(1, len(qid)))
    for pdf in frames:
        for at in range(0, len(pdf) if len(qid) else 0, step):
            some = pdf.iloc[at : at + step]
            v = np.stack(some["embedding"].to_numpy()).astype(np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            score, vid = q @ v.T, some["vec_id"].to_numpy()
            score[qid[:, None] == vid[None, :]] = -np.inf
            least = floor
            if np.isneginf(floor).any():
                # ties at the border are kept, to be settled by id
                n = min(k, len(vid))
                least = np.maximum(floor, -np.partition(-score, n - 1, axis=1)[:, n - 1])
            i, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
            best.append(pd.DataFrame({"query_id": qid[i], "vec_id": vid[j], "score": score[i, j]}))
            held += len(i)
            if held > 4 * k * len(qid):
                best = [_best(pd.concat(best), k)]
                per = best[0].groupby("query_id")["score"].agg(["size", "min"]).reindex(qid)
                floor, held = np.where(per["size"] >= k, per["min"], -np.inf), len(best[0])
    if best:
        yield _best(pd.concat(best), k)


def _best(df: pd.DataFrame, k: int) -> pd.DataFrame:
    return df.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, query: str, key: str, k: int, c: int = 60) -> DataFrame:
    """(query, key, score, rank): sums of 1 / (c + rank) over two ranked lists."""
    both = a.select(query, key, "rank").unionByName(b.select(query, key, "rank"))
    fused = both.groupBy(query, key).agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"))
    return top_k(fused, query, "score", key, k)
