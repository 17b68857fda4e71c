import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of small documents tables; extra columns get names that results also use."""

    def make(texts, lang="en", ids=None):
        rows = [(i if ids is None else ids[i], t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, SCHEMA)
        for name in ("kept", "shard", "fp", "length", "score", "row_key", "spans", "words", "rank", "n", "u", "key"):
            df = df.selectExpr("*", f"'clash' as {name}")
        return df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, very long, and unusual texts."""
    return [
        None, "", "   \n\t ", "a", "same text here", "same text here", None, "", "x" * 50_000, "no spaces" * 3,
        "word " * 20_000, "é ñ ü 漢字 🙂 \u2003 wide", "line\nline\nline\n", "\x00 nul \x1f", "@" * 3000, "+" * 3000,
        "1" * 5000, "1.1.1." * 2000, "AKIA", "password=", "[" * 100, "a@b.c " * 500,
        "1.2.3." + "0" * 5000, "0" * 6000 + ".0.0.0", "1.2.3." + "0" * 5000 + "256", "é" * 300_000,
    ]
