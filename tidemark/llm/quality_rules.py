"""Quality rules and a hashed n-gram log-likelihood ratio, on DataFrame functions alone.

Words and word pairs hash into ``buckets``; two multinomials over the buckets, of trusted texts and of all texts, give
each bucket a log ratio, and a document its mean over its n-grams. A document is kept if it passes the rules and its
score is not under the threshold, the exact trusted ``quantile``. That comes from one half of the trusted texts, scored
with the ratios of the other, as texts that the ratios have seen score too high. A word is hashed once; pairs and
windows hash its hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, exact_quantile, few, keyed_texts

BUCKETS = 8192
SPACE = r"[\x20\x09-\x0D]+"


def with_words(df: DataFrame) -> DataFrame:
    """Adds ``words`` and ``hashes``, one of each word; a null text has none."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), "")
    return df.withColumn("words", words).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def following(h: Column, by: int) -> Column:
    """``h`` from its element number ``by`` on, from 0."""
    return F.slice(h, by + 1, F.size(h))


def triples(h: Column) -> Column:
    """A hash of each window of three words."""
    pairs = F.zip_with(h, following(h, 1), lambda a, b: F.xxhash64(a, b))
    every = F.zip_with(pairs, following(h, 2), lambda a, b: F.xxhash64(a, b))
    return F.slice(every, 1, F.greatest(F.size(h) - 2, F.lit(0)))


def repeated_words(h: Column) -> Column:
    """Words in windows of three whose hash is in ``h`` twice or more: sorted by hash, neighbours tell."""
    by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        twin = F.transform(
            s,
            lambda x, i: F.when(
                ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]
            ),
        )
        return F.sort_array(F.filter(twin, lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
            F.lit(0).cast("bigint"),
            lambda a, x: a + x,
        )

    # a one-element transform names an intermediate value, so that it is made once
    once = F.transform(F.array(by_hash), positions)
    return F.get(F.transform(once, covered), F.lit(0))


def rules(df: DataFrame) -> DataFrame:
    """Adds the rules' counts to (text, words, hashes)."""
    text = F.coalesce("text", F.lit(""))
    df = df.withColumns({"lines": F.split(text, "\n"), "triples": triples(F.col("hashes"))})
    df = df.withColumn("distinct", F.size(F.array_distinct("triples")))
    zero = F.lit(0).cast("bigint")
    # looked at closely only where anything is there twice
    filled = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    twice = F.size(F.array_distinct("lines")) < F.size("lines")
    df = df.withColumns(
        {
            "n_words": F.size("words").cast("bigint"),
            "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint"),
            "n_dup_lines": F.when(twice, F.size(filled) - F.size(F.array_distinct(filled))).otherwise(0).cast("bigint"),
            "n_repeat_words": F.when(F.col("distinct") < F.size("triples"), repeated_words(F.col("triples"))).otherwise(zero),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("lines", "triples", "distinct")


def bucket_of(*hashes: Column, buckets: int) -> Column:
    """Bucket of a word by its hash, or of a pair by both."""
    h = hashes[0] if len(hashes) == 1 else F.xxhash64(*hashes)
    return F.pmod(h, F.lit(buckets)).cast("int")


def hashed(buckets: int) -> Column:
    """Buckets of the words and of the word pairs of ``hashes``."""
    h = F.col("hashes")
    one = F.transform(h, lambda a: bucket_of(a, buckets=buckets))
    two = F.zip_with(h, following(h, 1), lambda a, b: bucket_of(a, b, buckets=buckets))
    return F.concat(one, F.slice(two, 1, F.greatest(F.size(h) - 1, F.lit(0))))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids labelled of quality 1; broadcast only if they are few."""
    return few(labels.where("quality = 1").select(F.col(f"`{id_col}`").alias("doc_id")).dropna().distinct())


def in_half() -> Column:
    """Whether a trusted document is in the half that thresholds are not taken from."""
    return F.xxhash64("doc_id") % 2 == 0


def log_ratios(docs: DataFrame, ids: DataFrame, buckets: int = BUCKETS, prior: float = 1.0) -> DataFrame:
    """One row with ``ratios``: for each bucket log(trusted / raw), with ``prior`` added to each count; and with
    ``half_ratios``, the same with half of the trusted texts, null if there is none in that half.
    """
    marked = docs.join(ids.withColumn("half", in_half()), "doc_id", "left")
    grams = with_words(marked).select("half", F.explode(hashed(buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(
        F.count("*").alias("raw"), F.count("half").alias("target"), F.count_if("half").alias("half")
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(F.broadcast(counts), "bucket", "left").fillna(0)
    listed = full.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target", "half"))).alias("c"),
        *[F.sum(x).alias(f"all_{x}") for x in ("raw", "target", "half")],
    )
    add = F.lit(prior * buckets)

    def share(x: Column, name: str) -> Column:
        return F.log((x[name] + prior) / (F.col(f"all_{name}") + add))

    def ratio(name: str, none: Column) -> Column:
        some = F.transform("c", lambda x: share(x, name) - share(x, "raw"))
        return F.when(F.col(f"all_{name}") > 0, some).otherwise(none)

    zeros = F.transform("c", lambda x: F.lit(0.0))
    return listed.select(
        ratio("target", zeros).alias("ratios"), ratio("half", F.lit(None).cast("array<double>")).alias("half_ratios")
    )


def as_literal(values: list[float]) -> Column:
    """A constant array, which functions over arrays can use as it is; a column of it would be copied into each row."""
    return F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), "array<double>")


def mean_ratio(ratios: Column, buckets: int) -> Column:
    """The mean of ``ratios`` over the words and pairs of ``hashes``; 0 without any."""
    h, n = F.col("hashes"), F.size("hashes")
    each = F.zip_with(
        h, following(h, 1),
        lambda a, b: F.get(ratios, bucket_of(a, buckets=buckets))
        + F.when(b.isNull(), 0.0).otherwise(F.get(ratios, bucket_of(a, b, buckets=buckets))),
    )
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / (2 * n - 1)).otherwise(0.0)


def quality(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, quantile: float = 0.01,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, threshold, kept).

    One row for each row of ``docs``. Null and empty texts have no words, score 0 and fail the rules. Without trusted
    texts all ratios are 0, and without two halves of them the rules alone decide. Repeated rows count and are judged
    each. Labels of unknown documents and null labels have no effect. An empty table gives no rows.
    """
    base = keyed_texts(docs, id_col, text_col)
    ids = trusted_ids(labels)
    ratios = log_ratios(base, ids, buckets).first()  # ``buckets`` numbers, whatever the input
    df = rules(with_words(base))
    # only those documents are scored twice that could be among the unseen
    unseen = F.lit(None).cast("double")
    if ratios.half_ratios is not None:
        unseen = F.when(~in_half(), mean_ratio(as_literal(ratios.half_ratios), buckets))
    df = df.withColumns({"score": mean_ratio(as_literal(ratios.ratios), buckets), "unseen": unseen})
    out = cut(df.drop("text", "words", "hashes"))
    marked = cut(out.where("not base_failed and unseen is not null").join(ids, "doc_id", "left_semi").select("unseen"))
    q = cut(exact_quantile(marked, "unseen", quantile).select(F.col("quantile").alias("threshold")))
    out = out.drop("unseen").withColumn("threshold", q.scalar())
    passes = F.col("threshold").isNull() | (F.col("score") >= F.col("threshold"))
    return out.withColumn("kept", ~F.col("base_failed") & passes)
