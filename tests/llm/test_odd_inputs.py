"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import pytest

from tidemark.llm import (
    decontamination,
    exact_dedup,
    kneser_ney,
    license_scan,
    packing,
    pii,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    token_counts,
)


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(4, 1, 0), (11, 1, 0), (None, 1, None), (999, None, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "a b c d e f g h i j k l"), (3, "one two")], "item_id bigint, text string")
    return labels, bench


def operators(labels, bench):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return {
        "pii": pii.detect,
        "redact": pii.redact,
        "simhash": simhash.near_duplicates,
        "secrets": secret_scan.scan,
        "packing": packing.pack,
        "sharding": sharding.shard,
        "licenses": license_scan.scan,
        "rules": lambda d: quality_rules.quality(d, labels),
        "perplexity": lambda d: kneser_ney.classify(d, labels),
        "decontamination": lambda d: decontamination.matches(d, bench),
        "copies": exact_dedup.exact_dedup,
        "tokens": lambda d: token_counts.token_counts(d, model),
    }


NAMES = ["pii", "redact", "simhash", "secrets", "packing", "sharding", "licenses", "rules", "perplexity", "decontamination", "copies", "tokens"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, documents, odd_texts, tables):
    ids = [*range(len(odd_texts) - 2), None, 0]
    docs = documents(odd_texts, ids=ids).repartition(3)
    docs = docs.union(docs.where("doc_id = 5"))  # a whole row twice
    got = operators(*tables)[name](docs).collect()
    if name == "packing":
        assert len({(r.doc_id, r.start) for r in got if r.doc_id == 8}) == sum(r.doc_id == 8 for r in got)
        assert sum(r.doc_id == 5 for r in got) == 2
    elif name != "decontamination":
        assert len(got) == len(odd_texts) + 1
        assert sum(r.doc_id == 5 for r in got) == 2


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, documents, tables):
    docs = documents(["x"]).where("doc_id < 0")
    assert operators(*tables)[name](docs).collect() == []


@pytest.mark.parametrize("name", ["rules", "perplexity", "decontamination"])
def test_empty_other_table(name, documents, odd_texts, tables):
    labels, bench = (t.limit(0) for t in tables)
    got = operators(labels, bench)[name](documents(odd_texts)).collect()
    assert len(got) == (0 if name == "decontamination" else len(odd_texts))
