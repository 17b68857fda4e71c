"""Stages of the pipeline on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, near_copies

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(4, 1), (9, 1), (11, 1), (None, 1), (99, 0)], "doc_id bigint, quality int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven"), (None, "a b c d e f g h i j k l")], "item_id bigint, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


@pytest.fixture(scope="module")
def rows(odd_texts):
    texts = [*odd_texts, "say one two three four five six seven then", "write to jo@example.org", "1.2.3." + "0" * 5000]
    ids = [*range(len(texts) - 4), None, 0, *range(200, 202)]
    return texts, ids


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, documents, rows, folder, name):
    texts, ids = rows
    docs = documents(texts, ids=ids).repartition(3)
    docs = docs.union(docs.where("doc_id = 5"))
    out = stage(name)(spark, docs, folder)
    got = out.collect()
    if name == "best_fit_packing":
        assert sum(r.doc_id == 5 for r in got) == 2 and {r.doc_id for r in got} == set(ids)
        return
    assert out.columns == docs.columns
    kept = [r.text for r in got]
    if name == "near_dedup":
        blank = [t for t in kept if not (t or "").split()]
        assert len(blank) == 1 and kept.count("same text here") == 1 and sum(r.doc_id == 5 for r in got) == 0
    elif name == "benchmark_decontamination":
        assert len(got) == len(texts) and not any("one two three" in (t or "") for t in kept)
    elif name == "mask_pii":
        assert len(got) == len(texts) + 1 and "write to [EMAIL]" in kept and "[IP]" in kept and None in kept
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    else:
        assert got and all(r.kept == "clash" for r in got)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, documents, folder, name):
    docs = documents(["x"]).where("doc_id < 0")
    out = stage(name)(spark, docs, folder)
    assert out.collect() == [] and (name == "best_fit_packing" or out.columns == docs.columns)


def test_nulls_in_every_column(spark, folder):
    docs = spark.createDataFrame([(None,) * 5, (None,) * 5, (1, None, None, None, None), (2, "a b", None, None, None)], COLUMNS)
    for name, f in corpus_pipeline.STAGES:
        assert len(f(spark, docs, folder).collect()) == (2 if name == "near_dedup" else 4), name


def test_run_leaves_no_folder(spark, documents, rows, folder):
    documents(rows[0], ids=rows[1]).select(*[c.split()[0] for c in COLUMNS.split(", ")]).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    shared = common.shared_dir(spark).removeprefix("file:")
    out = corpus_pipeline.run(spark, folder)
    assert not [x for x in os.listdir(shared) if x.startswith("pipeline-")]
    assert out.count() > 0 and "sequence_id" in out.columns
    empty = f"{folder}/none"
    for t in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.mode("overwrite").parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_verdicts_do_not_leak_between_texts_of_one_id(spark, folder):
    """Rows are told apart by id and text: a passage goes, another text of its id stays."""
    docs = spark.createDataFrame([(1, "x one two three four five six seven y", "en", "s", 1), (1, "clean text", "en", "s", 1), (None, "one two three four five six seven", "en", "s", 1), (None, "z", "en", "s", 1)], COLUMNS)
    got = stage("benchmark_decontamination")(spark, docs, folder).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "z"), (1, "clean text")]


def test_large_groups_of_near_copies(spark):
    """Groups whose members differ by several words from each other: how many of the plain components are found whole."""
    import random

    from test_near_copies import brute, edited

    r = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for size, count, most in ((200, 150, 4), (120, 120, 3), (400, 100, 9)):
        base = [r.choice(vocab) for _ in range(size)]
        texts += [edited(r, base, r.randint(0, most)) for _ in range(count)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(docs, dense=20).select("doc_id", F.col("component_id")).collect()}
    want = brute(texts)
    assert all(want[i] == want[got[i]] for i in got)
    assert sum(got[i] == want[i] for i in got) >= 0.99 * len(texts)
