"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it again as the
next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, kneser_ney, near_copies, packing, pii, simhash
from tidemark.llm.common import drop_rows, read, remove, shared_dir

#: SQL has no expression for the stages' models.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose perplexity is above the threshold of their language and length.

    Null and empty texts are judged as an immediate end; rows with null ids are judged and rejected like others. Equal
    rows share their verdict. Without labelled trusted texts all stay. An empty table, or one with more columns, of any
    names, gives what is left of it with the same columns.
    """
    judged = kneser_ney.classify(docs, read(spark, sf_dir, "labels"))
    return drop_rows(docs, judged.where("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each component of texts whose five-word shingles are alike by 0.8 or more, one row of the smallest id.

    Null texts and texts without words are copies of each other. Of equal rows one stays; of rows of equal id and other
    texts the one whose key is smaller. Null ids give way to others. Columns are those given; an empty table stays empty.
    """
    rows = near_copies.near_copies(docs)
    return simhash.keep_representatives(docs, rows)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark.

    Null and empty texts hold none and stay, as does every row if the benchmark is empty. Equal rows go together, null
    ids like others. Columns are those given; an empty table stays empty.
    """
    found = decontamination.matches(docs, read(spark, sf_dir, "benchmark"))
    return drop_rows(docs, found)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows the text.

    Null texts stay null with a null n_chars, empty ones empty. All rows, repeated ones too, and all columns stay.
    """
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all pieces of all documents in sequences.

    A null or empty text is its end token alone; every row, repeated or with a null id, is packed. Other columns play no
    part. An empty table gives no rows.
    """
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mask_pii", mask_pii),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What lies between two stages is in the shared folder until the next one is written;
    the last holds its pieces in a checkpoint."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        last = None
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if last:
                remove(spark, last)
            last = f"{folder}/{name}"
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        remove(spark, folder)
