"""Functions of this library by name, for use from SQL: ``register(spark)``, then for instance

    SELECT doc_id, c.* FROM documents, LATERAL chunk_markdown(text, 800, 100, 120) AS c
    SELECT names_match(a, b), quote_score(quote, page), count_tokens(text) FROM ...
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from ..operators.ingest import chunk_markdown, html_to_markdown
from . import labels, text
from .identifiers import pattern_spans
from .prose import excerpt

_FOUND = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("where", T.StringType())]))
_SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("labelled", T.BooleanType())])
)


def _labelled(t: str) -> list[dict]:
    return [v._asdict() for v in labels.values(t)]


def _identifiers(t: str) -> list[dict]:
    return [{k: s[k] for k in ("kind", "start", "end", "value", "labelled")} for s in pattern_spans(t)]


def _markdown(html: str) -> str | None:
    try:
        return html_to_markdown(html)[1]
    except (AssertionError, RecursionError, ValueError):
        return None


#: Name, function of texts, result. A null among the texts gives null.
SCALARS: tuple[tuple[str, Callable, T.DataType], ...] = (
    ("normalize_text", text.normalize_text, T.StringType()),
    ("count_tokens", text.count_tokens, T.IntegerType()),
    ("labelled_values", _labelled, _FOUND),
    ("identifiers", _identifiers, _SPANS),
    ("html_to_markdown", _markdown, T.StringType()),
    ("names_match", text.names_match, T.DoubleType()),
    ("quote_score", text.quote_score, T.DoubleType()),
    ("partial_ratio", text.partial_ratio, T.DoubleType()),
)
PAIRS = frozenset(("names_match", "quote_score", "partial_ratio"))


def _one(fn: Callable, kind: T.DataType):
    @pandas_udf(kind)
    def udf(a: pd.Series) -> pd.Series:
        known = {x: None if x is None else fn(x) for x in set(a)}
        return pd.Series([known[x] for x in a], dtype="object")

    return udf


def _two(fn: Callable, kind: T.DataType):
    @pandas_udf(kind)
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        rows = list(zip(a, b))
        known = {x: None if None in x else fn(*x) for x in set(rows)}
        return pd.Series([known[x] for x in rows], dtype="object")

    return udf


class ChunkMarkdown:
    """(chunk, section, content, tokens) of a markdown text; null and empty texts have none. Rows cross in Arrow batches."""

    def eval(self, markdown: str | None, target: int, overlap: int, least: int) -> Iterator[tuple]:
        for i, c in enumerate(chunk_markdown(markdown, target, overlap, least) if markdown else []):
            yield i, c.section, c.content, c.tokens


class Excerpt:
    """(excerpt, whole): the text, or whole sentences or words of it up to a number of tokens."""

    def eval(self, content: str | None, most: int) -> Iterator[tuple]:
        if content is not None:
            short = excerpt(content, most)
            yield short, short == content


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; their names."""
    for name, fn, kind in SCALARS:
        spark.udf.register(name, (_two if name in PAIRS else _one)(fn, kind))
    tables = {
        "chunk_markdown": udtf(ChunkMarkdown, returnType="chunk int, section string, content string, tokens int", useArrow=True),
        "excerpt": udtf(Excerpt, returnType="excerpt string, whole boolean", useArrow=True),
    }
    for name, fn in tables.items():
        spark.udtf.register(name, fn)
    return [*(n for n, _, _ in SCALARS), *tables]
