"""Queries over what is read and written: layouts, receipts, frames, lines, stores, patches, redaction and batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import labels, prose, temporal
from ..functions import text as X
from ..functions.variants import as_texts, json_values
from ..operators import aliases, assembly, boxes, known_values, redaction
from ..operators.conversation import MessageFold
from ..sources import readers
from ..sources.adapter import table


def _strings(fn):
    """A vectorised UDF of one text column to a text."""

    @pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(fn)

    return udf


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as layouts of three pages, the second in two spans with words in both and outside; every fourth one without a
    list of pages; read back."""
    d = table(spark, sf_dir, "documents")
    n = F.length("text")
    a, b = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")
    span = lambda x, y: F.struct(x.alias("offset"), (y - x).alias("length"))
    word = lambda at: F.struct(F.lit("w").alias("content"), F.struct(at.alias("offset"), F.lit(1).alias("length")).alias("span"), F.lit("D(2,1.5,2,3,4)").alias("source"))
    none = F.array().cast("array<struct<content:string,span:struct<offset:int,length:int>,source:string>>")
    page = lambda i, *spans, words=none: F.struct(F.lit(i).alias("pageNumber"), F.array(*spans).alias("spans"), words.alias("words"))
    # the second page begins with the last part of the text
    pages = F.array(page(1, span(F.lit(0), a)), page(2, span(b, n), span(a, b), words=F.array(word(b), word(a), word(F.lit(0)), word(n + 5))), page(3, span(n, n)))
    layout = F.to_json(F.struct(F.replace("text", F.lit("\n"), F.lit("<!-- PageBreak -->")).alias("content"), F.when(F.col("doc_id") % 4 != 0, pages).alias("pages")))
    whole = F.to_json(F.struct(F.col("text").alias("content"), pages.alias("pages")))
    out = readers.layout_pages(d.select("doc_id", F.when(F.col("doc_id") % 4 == 0, layout).otherwise(whole).alias("json")))
    words = F.array_join(F.transform("words", lambda w: F.concat_ws("/", w["offset"].cast("string"), F.size(w["polygon"]).cast("string"))), ",")
    return out.select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("hash"), words.alias("words"))


_PAGES = "SELECT doc_id, text, length(text) AS n, length(text) // 3 AS a, length(text) // 2 AS b FROM documents WHERE doc_id % 4 <> 0"
LAYOUT_SQL = f"""WITH p AS ({_PAGES}) SELECT doc_id, 1 AS page, md5(substr(text, 1, a)) AS hash, '' AS words FROM p
UNION ALL SELECT doc_id, 2, md5(substr(text, b + 1) || substr(text, a + 1, b - a)), concat_ws(',', CASE WHEN b < n THEN '0/4' END, CASE WHEN a < b THEN n - b || '/4' WHEN a = b AND b < n THEN '0/4' END,
  CASE WHEN b = 0 AND n > 0 THEN '0/4' WHEN a = 0 AND b > 0 THEN n - b || '/4' END) FROM p
UNION ALL SELECT doc_id, 3, md5(''), '' FROM p
UNION ALL SELECT doc_id, CAST(i AS INTEGER), md5(l[i]), '' FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id % 4 = 0))"""


def receipts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as receipts, some fields missing, some unsure, two service lines, amounts as text or as numbers, read back."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = lambda c, sure=0.9: F.struct(c.alias("valueString"), F.lit(sure).alias("confidence"))
    even = F.coalesce(k % 2 == 0, F.lit(False))
    total = F.struct(
        F.when(even, F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("valueString"), F.when(~even, F.round("o_totalprice", 2)).alias("valueNumber"),
        ((k % 10) / 10).alias("confidence"),
    )
    line = lambda i: F.struct(
        F.struct(
            F.struct(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00")).alias("valueDate")).alias("serviceDate"), text(F.col("o_orderpriority")).alias("description"),
            F.struct((k + i).alias("valueInteger")).alias("itemCode"), F.struct(F.lit(float(i - 1)).alias("valueNumber")).alias("quantity"),
            F.struct(F.lit("$1,234.505").alias("valueString"), F.lit(0.5).alias("confidence")).alias("amount"),
        ).alias("valueObject")
    )
    body = F.to_json(
        F.struct(
            F.when(k % 3 != 0, text(F.col("o_orderpriority"))).alias("providerName"), F.struct(F.lit("").alias("valueString")).alias("providerType"),
            F.struct(k.alias("valueInteger")).alias("providerRegistrationNo"), F.when(k % 4 == 0, text(F.lit("aud"))).when(k % 4 == 1, text(F.lit("$"))).when(k % 4 == 2, text(F.lit("EUR"))).alias("currency"),
            F.when(k % 5 != 0, F.struct(F.array(line(0), line(1)).alias("valueArray"))).alias("serviceLines"),
            total.alias("total"),
        )
    )
    r = readers.parse_receipts(o.select("o_orderkey", body.alias("json")))
    lines = F.array_join(F.transform("lines", lambda x: F.concat_ws("/", x["service_date"].cast("string"), x["item_code"], x["quantity"].cast("string"), x["amount_cents"].cast("string"))), ";")
    issues = F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["code"], x["field"])), ",")
    return r.select("o_orderkey", "provider_name", "provider_no", "total_cents", "currency", lines.alias("lines"), F.array_join("missing", ",").alias("missing"), issues.alias("issues"), F.size("confidence").alias("sure"))


RECEIPTS_SQL = """WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS d, o_totalprice AS t FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 3 <> 0 THEN p END AS provider_name, CAST(k AS VARCHAR) AS provider_no, CAST(round(t * 100) AS BIGINT) AS total_cents,
  CASE k % 4 WHEN 0 THEN 'AUD' WHEN 2 THEN NULL ELSE 'CAD' END AS currency, CASE WHEN k % 5 <> 0 THEN d || '/' || k || '/123451;' || d || '/' || (k + 1) || '/0.0/123451' ELSE '' END AS lines,
  concat_ws(',', CASE WHEN k % 5 = 0 THEN 'serviceLines' END, CASE WHEN k % 4 IN (1, 3) THEN 'currency' END, CASE WHEN k % 3 = 0 THEN 'providerName' END, 'providerType') AS missing,
  concat_ws(',', CASE WHEN k % 5 = 0 THEN 'field_missing:serviceLines' END, CASE WHEN k % 4 IN (1, 3) THEN 'assumed_default:currency' END, CASE WHEN k % 3 = 0 THEN 'field_missing:providerName' END, 'field_missing:providerType',
    CASE WHEN k % 5 <> 0 THEN 'low_confidence:serviceLines[0].amountCents,low_confidence:serviceLines[1].amountCents' END, CASE WHEN k % 10 < 6 THEN 'low_confidence:totalCents' END) AS issues,
  CAST(1 + (k % 3 <> 0)::INT + (k % 4 <> 3)::INT + 4 * (k % 5 <> 0)::INT AS INTEGER) AS sure FROM o"""


def frames_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as frames of an event stream, one body a conversation's turn with a second frame of two data lines, read back."""
    t = table(spark, sf_dir, "conversations").withColumn("data", F.to_json(F.struct("text")))
    body = F.concat(readers.encode_frames(t, "role", "data"), F.lit(": a comment\r\n\r\nevent: note\r\ndata:first\r\ndata: second\r\n\r\n"))
    out = readers.parse_frames(t.select("conv_id", "turn", body.alias("body"), F.md5(F.col("data").cast("binary")).alias("sent")))
    return out.select("conv_id", "turn", "frame", "event", (F.md5(F.col("data").cast("binary")) == F.col("sent")).alias("same"), F.when(F.col("event") == "note", F.col("data")).alias("note"))


FRAMES_SQL = """SELECT conv_id, turn, 0 AS frame, role AS event, true AS same, CAST(NULL AS VARCHAR) AS note FROM conversations
UNION ALL SELECT conv_id, turn, 2, 'note', false, 'first' || chr(10) || 'second' FROM conversations"""


def manifest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's sources, of which two are asked for, beside documents by source."""
    sources = [{"id": f"src{i}", "url": f"https://x/{i}", "region": "CA" if i % 2 else "AU", "title": f"T{i}", "index": i % 3 != 0, "reproduction": {"verbatim": i == 4}} for i in range(20)]
    m = readers.load_manifest(spark, json.dumps({"sources": sources}), only=[f"src{i}" for i in range(3, 9)])
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    return m.join(d, "id", "left").select("id", "region", "index", "verbatim", "excerpt", F.coalesce("n", F.lit(0)).alias("n"))


MANIFEST_SQL = """WITH m AS (SELECT unnest(range(3, 9)) AS i), d AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT 'src' || i AS id, CASE WHEN i % 2 = 1 THEN 'CA' ELSE 'AU' END AS region, i % 3 <> 0 AS index, i = 4 AS verbatim, true AS excerpt, coalesce(n, 0) AS n FROM m LEFT JOIN d ON source = 'src' || i"""


def patched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of allowed columns, some of which can't be read, some not allowed."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    ways = ['{"p_size": "7", "p_partkey": "0"}', '{"p_size": "seven", "p_name": "new"}', "no json", '{"p_name": null}']
    patch = F.element_at(F.array(*[F.lit(w) for w in ways]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return assembly.apply_corrections(p.withColumn("patch", patch), "patch", {"p_size": "bigint", "p_name": "string"}).drop("patch")


PATCHED_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'new' ELSE p_name END AS p_name, CAST(CASE WHEN p_partkey % 4 = 0 THEN 7 ELSE p_size END AS BIGINT) AS p_size FROM part"""


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at paths with and without a star in documents made of parts."""
    paths = ["items.*.size", "items.0.name", "items.5.name", "tags.*", "none.*"]
    item = lambda k: F.struct((F.col("p_size") + k).alias("size"), F.col("p_name").alias("name"))
    doc = F.to_json(F.struct(F.array(item(0), item(1)).alias("items"), F.create_map(F.lit("a"), F.col("p_brand")).alias("tags")))
    p = table(spark, sf_dir, "part").select("p_partkey", doc.alias("document"))
    found = [F.array_join(as_texts(json_values(F.col("document"), path)), ",") for path in paths]
    return p.select("p_partkey", F.concat_ws("|", *found).alias("found"))


PATHS_SQL = "SELECT p_partkey, p_size || ',' || (p_size + 1) || '|' || p_name || '||' || p_brand || '|' AS found FROM part"


_COMMON = r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents),
c AS (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS k FROM w WHERE length(w) >= %d GROUP BY lang, w)"""


def _common_words(spark: SparkSession, sf_dir: str, least: int, most: int) -> DataFrame:
    """(lang, w, k): the most common words of each language, of at least so many characters."""
    w = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("w"))
    n = w.where(F.length("w") >= least).groupBy("lang", "w").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("k") <= most).drop("n")


def aliases_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the eight most common words of their language, of two characters or more, replaced by tokens, and with
    a number of ten written out in every document, in a way of its own."""
    words = _common_words(spark, sf_dir, 2, 8).select("lang", F.col("w").alias("value"), F.concat(F.lit("[WORD_"), "k", F.lit("]")).alias("token"), F.col("k").alias("order"))
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    i = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")
    numbers = langs.select("lang", i).select("lang", F.concat(F.lit("0416 555 010"), "i").alias("value"), F.concat(F.lit("[PHONE_"), "i", F.lit("]")).alias("token"), (F.col("i") + 100).alias("order"))
    tail = F.concat(F.lit("\ncall (041) 655-50.1"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("text", tail).alias("text"))
    out = aliases.apply_aliases(d, words.unionByName(numbers), "lang")
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"), F.size("replaced").cast("bigint").alias("n"))


ALIASES_SQL = rf"""{_COMMON % 2},
m AS (SELECT lang, map_from_entries(list((w, '[WORD_' || k || ']'))) AS m FROM c WHERE k <= 8 GROUP BY lang),
p AS (SELECT doc_id, m, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS p FROM documents JOIN m USING (lang)),
r AS (SELECT doc_id, array_to_string(list_transform(p, lambda x: coalesce(m[lower(x)], x)), '') AS text, len(list_filter(p, lambda x: m[lower(x)] IS NOT NULL)) AS n FROM p)
SELECT doc_id, md5(text || chr(10) || 'call ' || CASE WHEN doc_id % 100 < 10 THEN '[PHONE_' || (doc_id % 100) || ']' ELSE '(041) 655-50.1' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') END) AS hash,
  n + CASE WHEN doc_id % 100 < 10 THEN 1 ELSE 0 END AS n FROM r"""

def alias_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each conversation the first letters of its turns, written in three ways, given to three tokens in turn: values move from
    one to another, and some tokens lose all of theirs."""
    t, n = table(spark, sf_dir, "conversations"), F.col("turn")
    two = F.substring("text", 1, 1)
    value = F.when(n % 3 == 0, two).when(n % 3 == 1, F.concat(F.lit(" "), F.upper(two), F.lit("- "))).otherwise(F.concat(F.lit("("), F.lower(two), F.lit(")")))
    token = F.concat(F.lit("[MEMBER_"), F.element_at(F.array(*map(F.lit, "ABC")), ((F.col("conv_id") + n * n) % 3 + 1).cast("int")), F.lit("]"))
    rows = t.select("conv_id", n.alias("order"), token.alias("token"), F.when(n % 2 == 0, "member").otherwise("custom").alias("kind"), value.alias("value"))
    out = aliases.alias_book(rows, "conv_id")
    return out.select("conv_id", "token", "kind", F.array_join("values", "|").alias("values"), "removed")


MOVES_SQL = r"""WITH r AS (SELECT conv_id, turn, '[MEMBER_' || ['A', 'B', 'C'][(conv_id + turn * turn) % 3 + 1] || ']' AS token, CASE WHEN turn % 2 = 0 THEN 'member' ELSE 'custom' END AS kind,
    CASE turn % 3 WHEN 0 THEN text[1:1] WHEN 1 THEN ' ' || upper(text[1:1]) || '- ' ELSE '(' || lower(text[1:1]) || ')' END AS value FROM conversations),
k AS (SELECT *, strip_accents(lower(regexp_replace(value, '[^\p{L}\p{N}]', '', 'g'))) AS key FROM r),
m AS (SELECT *, lag(token) OVER (PARTITION BY conv_id, key ORDER BY turn) AS before FROM k WHERE key <> ''),
l AS (SELECT conv_id, key, arg_max(token, turn) AS token, arg_max(trim(value), turn) AS value, max(turn) AS turn FROM m WHERE before IS NULL OR before <> token GROUP BY 1, 2),
h AS (SELECT conv_id, token, string_agg(value, '|' ORDER BY turn) AS vs FROM l GROUP BY 1, 2)
SELECT e.conv_id, e.token, e.kind, coalesce(vs, '') AS values, vs IS NULL AS removed
FROM (SELECT conv_id, token, arg_min(kind, turn) AS kind FROM m GROUP BY 1, 2) e LEFT JOIN h USING (conv_id, token)"""


#: Words of the documents, tokens put in their place as they print, and what those are.
_DAMAGE = (
    (" the ", " {MEMBER A) ", " [MEMBER_A] "), (" la ", " PHONE_B ", " [PHONE_B] "), (" of ", " IMEMBER-CI ", " [MEMBER_C] "), (" de ", " MEMBER D ", " MEMBER D "),
    (" der ", " [NAME_A2] ", " [NAME_A2] "), (" und ", " (CERT 1 ", " [CERT_1] "), (" el ", " xID_1 ", " xID_1 "),
)


def tokens_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which common words are tokens, whole, damaged, or damaged too much to be told; made whole, with the places
    of the first one in both texts."""
    text = F.col("text")
    for word, damaged, _ in _DAMAGE:
        text = F.replace(text, F.lit(word), F.lit(damaged))
    out = aliases.repair_aliases(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    first = F.get("tokens", F.lit(0))
    return out.select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("hash"), F.size("tokens").cast("bigint").alias("n"),
        F.coalesce(first["start"], F.lit(-1)).cast("bigint").alias("first"), F.coalesce(first["was_start"], F.lit(-1)).cast("bigint").alias("was_first"),
    )


def _nested(column: int) -> str:
    out = "text"
    for row in _DAMAGE:
        out = f"replace({out}, '{row[0]}', '{row[column]}')"
    return out


_TOKEN_FORMS = [(d.strip(), t.strip()) for _, d, t in _DAMAGE if t.strip().startswith("[")]


def _first(column: str, forms: list[str]) -> str:
    """The least place of any of some forms between blanks."""
    return "coalesce(least({}), -1)".format(", ".join(f"CASE WHEN strpos({column}, ' {f} ') > 0 THEN strpos({column}, ' {f} ') END" for f in forms))


REPAIRED_SQL = f"""WITH r AS (SELECT doc_id, {_nested(1)} AS old, {_nested(2)} AS text FROM documents)
SELECT doc_id, md5(text) AS hash, {" + ".join(f"(length(text) - length(replace(text, '{t}', ''))) // {len(t)}" for _, t in _TOKEN_FORMS)} AS n,
  {_first("text", [t for _, t in _TOKEN_FORMS])} AS first, {_first("old", [d for d, _ in _TOKEN_FORMS])} AS was_first FROM r"""


def known_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of the three most common words of four characters or more of a language in its documents, whatever their
    case and accents, and the marks and blanks within them."""
    known = _common_words(spark, sf_dir, 4, 3).select("lang", F.col("w").alias("value"), F.lit("custom").alias("kind"), F.lit(False).alias("is_name"), F.lit(None).cast("string").alias("token"))
    found = known_values.find_known(table(spark, sf_dir, "documents"), known, "lang")
    return found.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "known")


# a word in up to eight runs of letters, of which the first begins it, with other characters between, which must not be too many
KNOWN_SQL = rf"""{_COMMON % 4},
r AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '\p{{L}}+|[^\p{{L}}]+')) AS r, generate_subscripts(regexp_extract_all(text, '\p{{L}}+|[^\p{{L}}]+'), 1) AS i FROM documents),
s AS (SELECT doc_id, lang, i, r, sum(length(r)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM r),
l AS (SELECT doc_id, lang, i, strip_accents(lower(r)) AS r, stop - length(r) AS start FROM s WHERE regexp_full_match(r, '\p{{L}}+')),
a AS (SELECT doc_id, i, start, w, strip_accents(w) AS f, l.r = strip_accents(w) AS whole FROM l JOIN c ON c.lang = l.lang AND c.k <= 3 AND starts_with(strip_accents(c.w), l.r)),
j AS (SELECT *, unnest(CASE WHEN whole THEN [0] ELSE range(1, 8) END) AS j FROM a),
o AS (SELECT *, unnest(range(0, 2 * j + 1)) AS o FROM j),
k AS (SELECT o.doc_id, o.i, o.start, j, w, f, string_agg(s.r, '' ORDER BY s.i) AS raw, count(*) AS n, regexp_full_match(last(s.r ORDER BY s.i), '\p{{L}}+') AS ends
  FROM o JOIN s ON s.doc_id = o.doc_id AND s.i = o.i + o.o GROUP BY ALL)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(raw) AS BIGINT) AS end, w AS known FROM k
WHERE n = 2 * j + 1 AND ends AND strip_accents(lower(regexp_replace(raw, '[^\p{{L}}\p{{N}}]', '', 'g'))) = f AND length(raw) <= 2 * length(w) + 4
  AND raw NOT LIKE '%' || chr(9) || '%' AND length(raw) - length(replace(raw, chr(10), '')) < 2"""


def labels_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and values in documents headed by a form: a number behind its label, a date under it, two columns, a name."""
    n = F.col("doc_id")
    six = lambda k: F.lpad(k.cast("string"), 6, "0")
    forms = [
        F.concat(F.lit("Policy no: G-"), six(n), F.lit("\n")),
        F.concat(F.lit("Date of birth\n"), F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), n.cast("int") % 20000), "yyyy-MM-dd"), F.lit("\n")),
        F.concat(F.lit("ID number\tDate of birth\n"), six(n), F.lit("\t2001-02-03\n"), six(n + 1), F.lit("\t3 May 1999\n\n")),
        F.concat(F.lit("Employer: Acme "), six(n), F.lit(" Ltd, member since\n")),
    ]
    form = F.element_at(F.array(*forms), (n % 4 + 1).cast("int"))

    @pandas_udf("array<struct<label:string,start:bigint,end:bigint,where:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"label": v.label, "start": v.start, "end": v.end, "where": v.where} for v in labels.values(t)] for t in texts])

    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(found(F.concat(form, "text"))).alias("v"))
    return d.select("doc_id", "v.*")


LABELS_SQL = """SELECT doc_id, v[1] AS label, CAST(v[2] AS BIGINT) AS start, CAST(v[3] AS BIGINT) AS end, v[4] AS where FROM (SELECT doc_id, unnest(CASE doc_id % 4
  WHEN 0 THEN [['policy', '11', '19', 'beside']] WHEN 1 THEN [['dob', '14', '24', 'under']]
  WHEN 2 THEN [['certificate', '24', '30', 'column'], ['certificate', '42', '48', 'column'], ['dob', '31', '41', 'column'], ['dob', '49', '59', 'column']]
  ELSE [['employer', '10', '25', 'beside']] END) AS v FROM documents)"""


def boxes_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents as boxes, ten a line and forty lines a page: a long word reaches its neighbour, of the same token if
    both have an even or both an odd number of letters; every seventh has a box within its own; every seventeenth word's is
    drawn by hand."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("i", "w"))
    n, i = F.length("w"), F.col("i")
    w = d.select(
        "doc_id", "i", F.floor(i / 400).alias("page"), F.concat(F.lit("[W_"), n % 2, F.lit("]")).alias("token"), F.lit(True).alias("enabled"),
        F.when(i % 17 == 0, "manual").otherwise("detector").alias("source"), (i % 10 / 10).alias("x"), (F.floor(i / 10) % 40 / 50).alias("y"),
        F.when(n > 3, 0.097).otherwise(0.05).alias("w"), F.lit(0.01).alias("h"), (n / 100.0).alias("confidence"),
    )
    inner = w.where("i % 7 = 0 and i % 17 > 0").withColumns({"x": F.col("x") + 0.01, "w": F.col("w") * 0.6, "confidence": F.lit(0.0)})
    out = boxes.merge_boxes(w.unionByName(inner))
    rounded = [F.round(c, 4).alias(c) for c in ("x", "y", "w", "confidence")]
    return out.select("doc_id", "page", "token", "source", *rounded, "members")


BOXES_SQL = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}]+'), 1) - 1 AS i FROM documents),
b AS (SELECT doc_id, i, length(w) AS n, i // 10 AS line, i % 17 = 0 AS hand, 1 + (i % 7 = 0 AND i % 17 > 0)::INT AS boxes FROM w),
g AS (SELECT *, CASE WHEN lag(n) OVER o > 3 AND lag(n) OVER o % 2 = n % 2 AND lag(line) OVER o = line AND NOT hand AND NOT lag(hand) OVER o THEN 0 ELSE 1 END AS new FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM g)
SELECT doc_id, min(i) // 400 AS page, '[W_' || any_value(n % 2) || ']' AS token, CASE WHEN any_value(hand) THEN 'manual' ELSE 'detector' END AS source, round(min(i % 10) / 10, 4) AS x, round(any_value(line % 40) / 50, 4) AS y,
  round(max(i % 10 / 10 + CASE WHEN n > 3 THEN 0.097 ELSE 0.05 END) - min(i % 10 / 10), 4)::DOUBLE AS w, round(max(n) / 100, 4) AS confidence, CAST(sum(boxes) AS BIGINT) AS members FROM s GROUP BY doc_id, s"""

_CHAT_TAILS = (
    (" dob: 3 May 19{:02}", "DateOfBirth", "hard"), (" card 9876-543-2{:02} AB", "CAHealthServiceNumber", "hard"), (" sin 046 454 2{:02}", "CASocialInsuranceNumber", "hard"),
    (" mail a{:02}@b.co", "Email", "advisory"), (" +1 416 555 01{:02}", "PhoneNumber", "advisory"), (" $1234567{:02}", None, None),
)


def chat_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers at the end of turns, with digits of the conversation's number in them, by category and tier."""
    digits = F.lpad((F.col("conv_id") % 100).cast("string"), 2, "0")
    tails = F.array(*[F.replace(F.lit(t), F.lit("{:02}"), digits) for t, _, _ in _CHAT_TAILS])
    t = table(spark, sf_dir, "conversations")
    text = F.concat("text", F.element_at(tails, ((F.col("conv_id") + F.col("turn")) % len(_CHAT_TAILS) + 1).cast("int")))
    found = redaction.chat_hits(t.select("conv_id", "turn", text.alias("text")))
    return found.select("conv_id", "turn", "category", "tier", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


_CHAT_ROWS = " ".join(
    f"WHEN {i} THEN ['{c}', '{k}', '{t.index(b)}', '{len(t.format(0))}']"
    for i, (t, c, k) in enumerate(_CHAT_TAILS)
    if c
    for b in [{"DateOfBirth": "dob", "CAHealthServiceNumber": "9876", "CASocialInsuranceNumber": "046", "Email": "a{", "PhoneNumber": "+1"}[c]]
)
CHAT_SQL = f"""WITH t AS (SELECT conv_id, turn, length(text) AS n, CASE (conv_id + turn) % {len(_CHAT_TAILS)} {_CHAT_ROWS} END AS v FROM conversations)
SELECT conv_id, turn, v[1] AS category, v[2] AS tier, n + CAST(v[3] AS BIGINT) AS start, n + CAST(v[4] AS BIGINT) AS end FROM t WHERE v IS NOT NULL"""


def batches_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in batches of at most three and 100,000 characters' worth of size."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 3 * 40 + 10).cast("int").alias("size"))
    return assembly.batches(t, "conv_id", "turn", "size", 3, 120).groupBy("conv_id", "batch").agg(F.count("*").alias("n"), F.sum("size").alias("total"))


# sizes go 10, 50, 90: of three in a row the third would make 150, so that batches are 10 50, 90 10, 50, 90 10, ...
BATCHES_SQL = """WITH RECURSIVE t AS (SELECT conv_id, turn, CAST(turn % 3 * 40 + 10 AS INTEGER) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, i, size, 0 AS batch, 1 AS n, size AS total FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.i, t.size, CASE WHEN r.n >= 3 OR r.total + t.size > 120 THEN r.batch + 1 ELSE r.batch END,
    CASE WHEN r.n >= 3 OR r.total + t.size > 120 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 3 OR r.total + t.size > 120 THEN t.size ELSE r.total + t.size END
  FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
SELECT conv_id, CAST(batch AS INTEGER) AS batch, count(*) AS n, CAST(sum(size) AS BIGINT) AS total FROM r GROUP BY 1, 2"""


def excerpts_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into whole sentences of at most twelve tokens, or whole words."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    ways = ["One two three.", "One two three. Four five six seven eight nine ten eleven twelve.", "one two three four five six seven eight nine ten eleven twelve thirteen", ""]
    text = F.element_at(F.array(*[F.lit(w) for w in ways]), (n % 4 + 1).cast("int"))
    return d.select("doc_id", _strings(lambda t: prose.excerpt(t, 12))(text).alias("text"))


EXCERPTS_SQL = """SELECT doc_id, ['One two three.', 'One two three. …', 'one two three four five six seven eight …', ''][doc_id % 4 + 1] AS text FROM documents"""


def pieces_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pieces for a service with a limit: how many, and that they make the text again."""

    def told(text: str) -> str:
        parts = prose.split_text(text, 1000)
        good = "".join(p for _, p in parts) == text and all(0 < len(p) <= 1000 for _, p in parts) and [a for a, _ in parts][:1] in ([0], [])
        return f"{good}:{len(parts) >= -(-len(text) // 1000)}:{len(parts) <= 2 * -(-len(text) // 1000)}"

    return table(spark, sf_dir, "documents").select("doc_id", _strings(told)("text").alias("told"))


PIECES_SQL = "SELECT doc_id, 'True:True:True' AS told FROM documents"


def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a message made of a step and a call goes on: only if the call has ended."""
    states = [["tool-input-available"], ["tool-input-available", "tool-output-available"], ["tool-input-available", "tool-output-denied"], [], ["tool-input-available", "tool-output-available", "start-step"]]

    def goes_on(n: str) -> str:
        kinds = states[int(n) % len(states)]
        return str(MessageFold.of([{"type": "start-step"}, *({"type": k, "toolCallId": "c", "toolName": "t"} for k in kinds)]).continues())

    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", _strings(goes_on)(F.col("turn").cast("string")).alias("goes_on"))


CONTINUATIONS_SQL = "SELECT conv_id, turn, ['False', 'True', 'True', 'False', 'False'][turn % 5 + 1] AS goes_on FROM conversations"


def dates_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict dates, and seconds to the next UTC midnight."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.date_format("ts", "yyyy-M-d")).when(k == 2, F.lit("2023-02-29")).otherwise(F.lit("0000-01-01"))
    return e.select("event_id", temporal.parse_date(text).alias("day"), temporal.seconds_to_midnight(F.col("ts")).alias("left_s"))


DATES_SQL = """SELECT event_id, CASE WHEN event_id % 4 = 0 OR (event_id % 4 = 1 AND month(ts) >= 10 AND day(ts) >= 10) THEN CAST(ts AS DATE) END AS day,
  CAST(epoch(date_trunc('day', ts) + INTERVAL 1 DAY) - epoch(date_trunc('second', ts)) AS BIGINT) AS left_s FROM events"""


def vectors_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that texts alone decide: of length one, and the same for equal texts."""

    @pandas_udf("double")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(float(X.hash_vector(x) @ X.hash_vector(y)), 9) for x, y in zip(a, b)])

    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", same("p_name", "p_name").alias("same"), (same("p_name", F.concat(F.col("p_name"), F.lit("!"))) < 0.9).alias("other"))


VECTORS_SQL = "SELECT p_partkey, 1.0::DOUBLE AS same, true AS other FROM part"

QUERIES = {
    "layout_pages": (layout_pages, LAYOUT_SQL),
    "receipts_read": (receipts_read, RECEIPTS_SQL),
    "frames_read": (frames_read, FRAMES_SQL),
    "manifest_sources": (manifest_sources, MANIFEST_SQL),
    "patched_rows": (patched_rows, PATCHED_SQL),
    "json_paths": (json_paths, PATHS_SQL),
    "aliases_applied": (aliases_applied, ALIASES_SQL),
    "alias_moves": (alias_moves, MOVES_SQL),
    "tokens_repaired": (tokens_repaired, REPAIRED_SQL),
    "known_places": (known_places, KNOWN_SQL),
    "labels_found": (labels_found, LABELS_SQL),
    "boxes_merged": (boxes_merged, BOXES_SQL),
    "chat_hits": (chat_hits, CHAT_SQL),
    "batches_planned": (batches_planned, BATCHES_SQL),
    "excerpts_cut": (excerpts_cut, EXCERPTS_SQL),
    "pieces_split": (pieces_split, PIECES_SQL),
    "continuations": (continuations, CONTINUATIONS_SQL),
    "dates_parsed": (dates_parsed, DATES_SQL),
    "vectors_made": (vectors_made, VECTORS_SQL),
}
