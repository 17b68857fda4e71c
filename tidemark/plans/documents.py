"""Queries over documents, pages, vectors and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import text as X
from ..operators import assembly, evals, ingest, search, suppression
from ..sources.adapter import table

CATEGORY_TAGS = {"english": ["the ", " of "], "german": ["und ", " der "], "spanish": [" que", " los "], "french": [" les ", " une "], "licence": ["license", "reserved"]}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def dedupe_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("hash"))
    return assembly.dedupe_ranked(d, ["hash", "lang"], [F.col("source"), F.col("doc_id")]).select("doc_id", "lang", "hash")


DEDUPE_SQL = """SELECT doc_id, lang, hash FROM (SELECT doc_id, lang, md5(text) AS hash,
  row_number() OVER (PARTITION BY md5(text), lang ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1"""


def fuzzy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, written in three ways, within their brand and kind: what a page and an identity are to a row."""
    way = F.element_at(F.array(F.col("p_name"), F.concat(F.upper("p_name"), F.lit("s")), F.concat(F.lit("the "), F.col("p_name"), F.lit(" with all that goes with it"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    p = table(spark, sf_dir, "part").withColumns({"quote": way, "confidence": (F.col("p_size") % 100) / 100})
    return suppression.fuzzy_dedupe(p, ["p_brand", "p_type"], "p_partkey", "quote", "confidence")


BENEFIT_NAMES = ["small rings", "red widgets", "large bolt", "Massage therapy", "green gear assembly", "Blue valve", "heavy chain", "Dental"]


def entity_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.link_names(table(spark, sf_dir, "part"), "p_name", BENEFIT_NAMES, 70.0)


def _pages_of_ten(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of documents (doc_id, n, line), and the documents' pages of ten lines."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    entry = F.struct("n", "line")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["line"]), "\n")
    return lines, lines.groupBy("doc_id", F.floor(F.col("n") / 10).cast("int").alias("page")).agg(text.alias("text"))


def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's lines stand among the document's own pages of ten lines, each said to be from the page before its
    own; in every third one letters are misread, so that it has to be scored."""
    lines, pages = _pages_of_ten(spark, sf_dir)
    misread = F.concat(F.substring("line", 1, 5), F.lit("~"), F.substring("line", 7, 1 << 30))
    quote = F.when((F.col("n") % 3 == 1) & (F.length("line") > 6), misread).otherwise(F.col("line"))
    said = F.greatest(F.floor(F.col("n") / 10).cast("int") - 1, F.lit(0)).alias("said")
    quotes = lines.where("trim(line) <> ''").select("doc_id", F.concat_ws("-", "doc_id", "n").alias("quote_id"), quote.alias("quote"), said)
    return assembly.ground_quotes(quotes, pages, "doc_id", "said")


def quotes_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where lines that are printed right stand: on the first page that holds them in normal form, with a score of 100."""
    lines, pages = _pages_of_ten(spark, sf_dir)
    quotes = lines.select("doc_id", F.concat_ws("-", "doc_id", "n").alias("quote_id"), F.concat(F.lit("**"), F.replace("line", F.lit("-"), F.lit("–")), F.lit("`  ")).alias("quote"))
    return assembly.ground_quotes(quotes, pages, "doc_id", least=100.0).fillna(-1, ["page"])


_NORMAL = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(translate({0}, '‘’“”–—' || chr(160), '''''""-- '), '<[^>]+>', ' ', 'g'), '[|*#`>~]+', ' ', 'g'), '\s+', ' ', 'g')))"""
CONTAINED_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
p AS (SELECT doc_id, n // 10 AS page, {_NORMAL.format("string_agg(line, chr(10) ORDER BY n)")} AS t FROM l GROUP BY 1, 2),
q AS (SELECT doc_id, doc_id || '-' || n AS quote_id, {_NORMAL.format("line")} AS q FROM l),
b AS (SELECT quote_id, min(page) AS page FROM q JOIN p USING (doc_id) WHERE q <> '' AND contains(t, q) GROUP BY 1)
SELECT quote_id, CAST(coalesce(page, -1) AS INTEGER) AS page, CASE WHEN page IS NULL THEN 0.0 ELSE 100.0 END::DOUBLE AS score FROM q LEFT JOIN b USING (quote_id)"""


def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", F.ceil(F.col("n_chars") / 500).cast("int").alias("pages"))
    return assembly.page_windows(d, "doc_id", "pages")


PAGE_WINDOWS_SQL = """WITH p AS (SELECT doc_id, CAST(ceil(n_chars / 500) AS INTEGER) AS pages FROM documents),
s AS (SELECT doc_id, pages, unnest(generate_series(1, greatest(1, pages - 1), 4)) AS first FROM p WHERE pages > 0)
SELECT doc_id, CAST((first - 1) // 4 AS INTEGER) AS "window", CAST(first AS INTEGER) AS first, CAST(least(first + 4, pages) AS INTEGER) AS last FROM s"""


def uncovered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from 1 to each source's largest id that none of its documents in English has."""
    d = docs(spark, sf_dir)
    last = d.groupBy("source").agg(F.max("doc_id").alias("last"))
    covered = d.where("lang = 'en'").select("source", F.col("doc_id").alias("page")).distinct()
    return assembly.uncovered(last, covered, "source", "last")


UNCOVERED_SQL = """WITH l AS (SELECT source, max(doc_id) AS m FROM documents GROUP BY 1),
p AS (SELECT source, unnest(generate_series(1, m)) AS page FROM l)
SELECT source, page FROM p WHERE NOT EXISTS (
  SELECT 1 FROM documents d WHERE d.source = p.source AND d.doc_id = p.page AND d.lang = 'en')"""


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with marks put in at their words: entities, underscores, tildes, tags, guillemets and typographic marks."""
    text = F.col("text")
    for a, b in NORMALIZED_MARKS:
        text = F.replace(text, F.lit(a), F.lit(b))
    t = X.normalize_ascii(text)
    return docs(spark, sf_dir).select(
        "doc_id", F.md5(t.cast("binary")).alias("hash"), F.length(t).cast("bigint").alias("n"),
        X.slug(F.concat_ws(" ", F.lit("Équipe — ﬁne"), "source", "lang", F.col("doc_id").cast("string"))).alias("slug"),
        F.array_join(X.distinct_list(F.concat(F.col("source"), F.lit(" ,\n"), F.col("lang"), F.lit(";; "), F.col("source"), F.lit("\n"), F.lit("x"))), "/").alias("parts"),
    )


NORMALIZED_MARKS = (
    (" th", " ~_th"), (" in ", " &amp; "), (" la", " <b>*la*</b>"), (" de ", " «de» "), (". ", "’. “x” – y— \\ > `z` # "), (" and ", " a < b and c > d ")
)
_MARKED = "text"
for _a, _b in NORMALIZED_MARKS:
    _MARKED = f"replace({_MARKED}, '{_a}', '{_b}')"
NORMALIZED_SQL = rf"""WITH n AS (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(
    translate({_MARKED}, '‘’“”–—' || chr(160), '''''""-- '), '<[^>]+>', ' ', 'g'), '[|*#`>~]+', ' ', 'g'),
    '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS t FROM documents)
SELECT doc_id, md5(t) AS hash, length(t) AS n,
  'equipe-fine-' || regexp_replace(source || '-' || lang || '-' || doc_id, '[^a-z0-9]+', '-', 'g') AS slug, source || '/' || lang || '/x' AS parts FROM n"""


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.token_count(F.col("text")).alias("tokens"), F.ceil(F.length("text") / 1000).alias("records"))


TOKEN_COUNTS_SQL = r"""SELECT doc_id, CAST(greatest(len(regexp_extract_all(text, '([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])')),
  ceil(length(text) / 3.5)) AS BIGINT) AS tokens, CAST(ceil(length(text) / 1000) AS BIGINT) AS records FROM documents"""


def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.convert_pages(table(spark, sf_dir, "pages"))


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunk_documents(table(spark, sf_dir, "pages"), target=200, overlap=40, least=40)


def content_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.with_hashes(docs(spark, sf_dir).withColumn("section", F.col("lang"))).select("doc_id", "id", "content_hash")


HASH_SQL = """SELECT doc_id, source || '-' || substr(sha256(lang || chr(10) || text), 1, 20) AS id, sha256(text) AS content_hash FROM documents"""


def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against an index that lacks some, has others changed, and some that are no more."""
    d = docs(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    changed = F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("content_hash"))
    index = d.where("doc_id % 3 <> 0").select("doc_id", changed.alias("content_hash"))
    every = [ingest.index_changes(d.where("doc_id % 7 <> 0"), index, key="doc_id", force=f).withColumn("forced", F.lit(f)) for f in (False, True)]
    return every[0].unionByName(every[1])


INCREMENTAL_SQL = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'stale'
  WHEN doc_id % 5 = 0 OR forced THEN 'changed' ELSE 'kept' END AS status, forced FROM documents, (SELECT unnest([false, true]) AS forced) WHERE doc_id % 7 <> 0 OR doc_id % 3 <> 0"""


def identifier_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.detections(docs(spark, sf_dir))


def _number(length: int, factor: int) -> Column:
    return F.lpad(((F.col("doc_id") * factor + 123_456_789) % 10**length).cast("string"), length, "0")


def checksum_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of generated numbers, made so that most lengths and many digits occur."""
    nine, ten, eleven = _number(9, 7_919), _number(10, 104_729), _number(11, 15_485_863)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return docs(spark, sf_dir).select(
        "doc_id", yes(I.is_luhn(nine)).alias("luhn"), yes(I.is_sin(nine)).alias("sin"), yes(I.is_tfn(nine)).alias("tfn"),
        yes(I.is_ontario_health(ten)).alias("ohip"), yes(I.is_bc_phn(F.concat(F.lit("9"), nine))).alias("bc"),
        yes(I.is_medicare(ten)).alias("medicare"), yes(I.is_medicare(F.concat(ten, (F.col("doc_id") % 3).cast("string")))).alias("medicare_11"), yes(I.is_abn(eleven)).alias("abn"),
        yes(I.is_ihi(F.concat(F.lit("800360"), ten))).alias("ihi"), yes(I.is_ihi(F.concat(F.lit("800361"), ten))).alias("ihi_other"),
        yes(I.is_ramq(F.concat(F.lit("TREM"), F.substring(eleven, 4, 8)))).alias("ramq"), I.postcode_state((F.col("doc_id") % 5 + 6795).cast("string")).alias("west"),
        I.postcode_state(F.substring(nine, 1, 4)).alias("state"),
    )


def _luhn_sql(n: str) -> str:
    return f"""(list_sum(list_transform(generate_series(1, length({n})), lambda i:
      CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({n}), i, 1) AS INTEGER)
      ELSE (CAST(substr(reverse({n}), i, 1) AS INTEGER) * 2) // 10 + (CAST(substr(reverse({n}), i, 1) AS INTEGER) * 2) % 10 END)) % 10 = 0)"""


def _weighted_sql(n: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr({n}, {i}, 1) AS INTEGER)" for i, w in enumerate(weights, 1)) + ")"


_BC_SQL = "(" + " + ".join(f"({w} * CAST(substr(a, {i}, 1) AS INTEGER)) % 11" for i, w in enumerate(I.BC_WEIGHTS, 1)) + ")"
_STATES_SQL = " ".join(f"WHEN p BETWEEN {a} AND {b} THEN '{s}'" for s, a, b in I.POSTCODES)
CHECKSUM_SQL = f"""WITH n AS (SELECT doc_id, lpad(CAST((doc_id * 7919 + 123456789) % 1000000000 AS VARCHAR), 9, '0') AS a,
  lpad(CAST((doc_id * 104729 + 123456789) % 10000000000 AS VARCHAR), 10, '0') AS b,
  lpad(CAST((doc_id * 15485863 + 123456789) % 100000000000 AS VARCHAR), 11, '0') AS c FROM documents),
m AS (SELECT *, CAST(substr(a, 1, 4) AS INTEGER) AS p, 11 - {_BC_SQL} % 11 AS k FROM n)
SELECT doc_id, {_luhn_sql('a')} AS luhn, substr(a, 1, 1) <> '8' AND {_luhn_sql('a')} AS sin,
  {_weighted_sql('a', I.TFN_WEIGHTS)} % 11 = 0 AS tfn, substr(b, 1, 1) <> '0' AND {_luhn_sql('b')} AS ohip,
  k < 10 AND k = CAST(substr(a, 9, 1) AS INTEGER) AS bc,
  substr(b, 1, 1) BETWEEN '2' AND '6' AND {_weighted_sql('b', I.MEDICARE_WEIGHTS)} % 10 = CAST(substr(b, 9, 1) AS INTEGER) AS medicare,
  doc_id % 3 > 0 AND substr(b, 1, 1) BETWEEN '2' AND '6' AND {_weighted_sql('b', I.MEDICARE_WEIGHTS)} % 10 = CAST(substr(b, 9, 1) AS INTEGER) AS medicare_11,
  {_luhn_sql("('800360' || b)")} AS ihi, false AS ihi_other, 'WA' AS west,
  CASE WHEN CAST(substr(c, 6, 2) AS INTEGER) > 50 THEN CAST(substr(c, 6, 2) AS INTEGER) - 50 ELSE CAST(substr(c, 6, 2) AS INTEGER) END BETWEEN 1 AND 12
    AND CAST(substr(c, 8, 2) AS INTEGER) BETWEEN 1 AND 31 AS ramq,
  substr(c, 1, 1) <> '0' AND ({_weighted_sql('c', I.ABN_WEIGHTS)} - 10) % 89 = 0 AS abn, CASE {_STATES_SQL} END AS state FROM m"""


def span_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of made-up spans of each document, and the best span of each."""
    k = F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k")
    s = docs(spark, sf_dir).select("doc_id", k)
    start = (F.col("doc_id") * (F.col("k") + 3) + F.col("k") * 11) % 60
    s = s.select(
        "doc_id", F.element_at(F.array(*[F.lit(x) for x in ("name", "phone", "email")]), (F.col("k") % 3 + 1).cast("int")).alias("kind"),
        start.cast("int").alias("start"), (start + 4 + (F.col("doc_id") * F.col("k")) % 9).cast("int").alias("end"),
        ((F.col("doc_id") + F.col("k")) % 10).cast("int").alias("score"),
    ).distinct()
    priority = F.when(F.col("kind") == "email", 2).when(F.col("kind") == "phone", 1).otherwise(0)
    return I.best_of_cluster(s, ["doc_id"], priority, (F.col("kind") == "name") & (F.col("start") % 3 == 0))


SPAN_SQL = """WITH k AS (SELECT doc_id, unnest(generate_series(1, 6)) AS k FROM documents),
s AS (SELECT DISTINCT doc_id, CASE k % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'phone' ELSE 'email' END AS kind,
  CAST((doc_id * (k + 3) + k * 11) % 60 AS INTEGER) AS start, CAST((doc_id * (k + 3) + k * 11) % 60 + 4 + (doc_id * k) % 9 AS INTEGER) AS "end",
  (doc_id + k) % 10 AS score FROM k),
b AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
c AS (SELECT *, sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, kind ROWS UNBOUNDED PRECEDING) AS cluster FROM b),
o AS (SELECT *, (kind <> 'email' AND EXISTS (SELECT 1 FROM c e WHERE e.doc_id = c.doc_id AND e.cluster = c.cluster AND e.kind = 'email' AND e.start <= c.start AND e."end" >= c."end"
    AND e."end" - e.start > c."end" - c.start)) OR (kind = 'name' AND start % 3 = 0 AND "end" - start < 0.6 * (max("end") OVER (PARTITION BY doc_id, cluster) - min(start) OVER (PARTITION BY doc_id, cluster))) AS out FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY out, CASE kind WHEN 'email' THEN 2 WHEN 'phone' THEN 1 ELSE 0 END,
  score DESC, start, kind) AS n, min(start) OVER (PARTITION BY doc_id, cluster) AS "from",
  max("end") OVER (PARTITION BY doc_id, cluster) AS "to", count(*) OVER (PARTITION BY doc_id, cluster) AS members FROM o)
SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, kind, start, "end", "from", "to", members FROM r WHERE n = 1"""


def excerpt_overrun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that quote more of a passage than an excerpt may, and than eight words."""
    d, b = docs(spark, sf_dir), table(spark, sf_dir, "benchmark")
    every = [evals.overruns(d, b, most).withColumn("most", F.lit(most)) for most in (evals.EXCERPT_WORDS, 8)]
    return every[0].unionByName(every[1])


def _overrun_sql(most: int) -> str:
    w = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
    grams = "SELECT DISTINCT id, array_to_string(w[i:i + {0}], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - {0})) AS i FROM {1} WHERE len(w) > {0})"
    return f"""SELECT * FROM (WITH d AS (SELECT doc_id AS id, {w} AS w FROM documents), b AS (SELECT item_id AS id, {w} AS w FROM benchmark),
dg AS ({grams.format(most, 'd')}), bg AS ({grams.format(most, 'b')})
SELECT dg.id AS doc_id, bg.id AS item_id, count(*) AS shared, {most} AS most FROM dg JOIN bg USING (g) GROUP BY 1, 2)"""


OVERRUN_SQL = f"{_overrun_sql(50)} UNION ALL {_overrun_sql(8)}"


def keyword_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.tags(F.col("text"), CATEGORY_TAGS, hints=F.array("lang"))
    return docs(spark, sf_dir).select("doc_id", F.array_join(found, ",").alias("tags"))


_TAGS = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {k!r})' for k in ks)} THEN '{t}' END" for t, ks in CATEGORY_TAGS.items())
TAGS_SQL = f"""SELECT doc_id, array_to_string(list_filter([lang, {_TAGS}], lambda x: x IS NOT NULL)[1:6], ',') AS tags FROM documents"""


def overlap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark against documents of one language, by the number of the passage."""
    region = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (F.col("item_id") % 5 + 1).cast("int"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", region.alias("region"))
    return search.overlap_search(q, docs(spark, sf_dir).select("doc_id", "text", F.col("lang").alias("region"))).drop("score")


LANGUAGES = ["en", "de", "fr", "es", "xx"]


def overlap_sql(queries: str, documents: str, k: int) -> str:
    """``queries`` (query_id, text, region), ``documents`` (doc_id, text, region)."""
    t = "list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))"
    return f"""WITH q AS (SELECT query_id, region, {t} AS t FROM ({queries})), d AS (SELECT doc_id, region, {t} AS t FROM ({documents})),
h AS (SELECT query_id, doc_id, len(list_intersect(q.t, d.t)) AS hits, len(q.t) AS size FROM q JOIN d USING (region)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM h)
SELECT query_id, doc_id, hits, size, rank FROM r WHERE rank <= {k}"""


OVERLAP_SQL = overlap_sql(f"SELECT item_id AS query_id, text, {LANGUAGES}[item_id % 5 + 1] AS region FROM benchmark", "SELECT doc_id, text, lang AS region FROM documents", 5)


def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"), F.col("lang").alias("region"))
    return search.substring_search(d, "What does the license, public password version of THE all rights?", "en")


_HAY = "lower(source || ' ' || text)"
_SCORE = " + ".join(f"contains({_HAY}, '{w}')::BIGINT" for w in ("license", "public", "password", "version", "all", "rights"))
SUBSTRING_SQL = f"""SELECT doc_id, CAST({_SCORE} AS BIGINT) AS score, CAST(least(4, {_SCORE}) AS BIGINT) AS reranked FROM documents
WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 3"""
_FIELDS = {"p_name": 3.0, "p_type": 2.0, "p_brand": 1.0}


def benefit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fielded_search(table(spark, sf_dir, "part"), _FIELDS, "How much small rin of econ 7 s", "p_partkey", 24)


def _field_sql(word: str) -> str:
    per = []
    for f, b in _FIELDS.items():
        words = f"regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}_''-]+')"
        begins = f"WHEN len(list_filter({words}, lambda w: starts_with(w, '{word}'))) > 0 THEN {b / 2}" if len(word) > 1 else ""
        per.append(f"CASE WHEN list_contains({words}, '{word}') THEN {b} {begins} ELSE 0 END")
    return f"greatest({', '.join(per)})"


FIELD_SQL = f"""WITH s AS (SELECT p_partkey, CAST({' + '.join(_field_sql(w) for w in ('small', 'rin', 'econ', '7', 's'))} AS DOUBLE) AS score FROM part)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 24"""


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_search(table(spark, sf_dir, "part"), _FIELDS, "How much small ringg economy st plate9", "p_partkey", 24)


def bm25_sql(rows: str, key: str, fields: dict[str, float], words: list[str], k: int, prefix_from: int, fuzzy_from: int) -> str:
    stop = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
    posts = " UNION ALL ".join(
        f"SELECT {key} AS key, {b} AS boost, unnest(list_filter(regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}_''-]+'), lambda w: w NOT IN ({stop}))) AS term FROM d" for f, b in fields.items()
    )
    forms = []
    for w in words:
        head = f"WHEN starts_with(term, '{w}') THEN 0.375" if len(w) >= prefix_from else ""
        near = f"WHEN levenshtein(term, '{w}') <= {round(0.2 * len(w))} THEN 0.45" if len(w) >= fuzzy_from and not any(c.isdigit() for c in w) else ""
        forms.append(f"CASE WHEN term = '{w}' THEN 1.0 {head} {near} ELSE 0.0 END")
    return f"""WITH d AS ({rows}), p AS ({posts}), t AS (SELECT key, term, sum(boost)::DOUBLE AS tf, greatest({', '.join(forms)})::DOUBLE AS w FROM p GROUP BY 1, 2),
h AS (SELECT * FROM t WHERE w > 0), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1), n AS (SELECT count(*) AS n FROM d),
s AS (SELECT key AS {key}, round(sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)), 6) AS score FROM h JOIN f USING (term), n GROUP BY 1)
SELECT * FROM s ORDER BY score DESC, {key} LIMIT {k}"""


RANKED_SQL = bm25_sql("SELECT * FROM part", "p_partkey", _FIELDS, ["small", "ringg", "economy", "st", "plate9"], 24, 2, 4)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search.vector_top_k(v, v.where("vec_id % 100 = 0"), 5).drop("score")


VECTOR_SQL = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(e, CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank FROM r WHERE rank <= 5"""


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stand for vectors of the same number, by words and by vector, ranks fused."""
    v, d = table(spark, sf_dir, "embeddings"), docs(spark, sf_dir)
    some = v.where("vec_id % 100 = 0")
    by_vector = search.vector_top_k(v, some, 25).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    q = d.join(some.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "text")
    by_word = search.overlap_search(q, d.select("doc_id", "text"), 25).where("doc_id <> query_id and hits > 0")
    return search.reciprocal_rank_fusion(by_word, by_vector, "query_id", "doc_id", 5)


HYBRID_SQL = f"""WITH a AS ({overlap_sql("SELECT doc_id AS query_id, text, 1 AS region FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)", "SELECT doc_id, text, 1 AS region FROM documents", 25)}),
b AS ({VECTOR_SQL.replace('rank <= 5', 'rank <= 25')}),
u AS (SELECT query_id, doc_id, rank FROM a WHERE doc_id <> query_id AND hits > 0 UNION ALL SELECT query_id, vec_id, rank FROM b),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5"""


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = docs(spark, sf_dir).select(F.explode(X.tags(F.col("text"), CATEGORY_TAGS, hints=F.array("lang"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


FACETS_SQL = f"SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(tags, ',')) AS tag FROM ({TAGS_SQL})) GROUP BY 1"


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of vectors with their labels."""
    return ingest.index_statistics(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")


STATISTICS_SQL = """SELECT count(*) AS documents, CAST(sum(length('{"vec_id":' || vec_id || '}')) AS BIGINT) AS bytes, CAST(sum(len(embedding) * 4) AS BIGINT) AS vector_bytes FROM embeddings"""


def licensed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their sources: a third of these only linked, a third in excerpts, a third whole."""
    d = docs(spark, sf_dir)
    n = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") % 3
    sources = d.select("source", F.coalesce(n != 0, F.lit(True)).alias("index"), F.coalesce(n == 1, F.lit(True)).alias("verbatim")).distinct()
    short = F.when(F.length("text") < 100, F.col("text")).otherwise(F.concat(F.repeat(F.lit("word "), 299), F.lit("word. End.")))
    out = ingest.licensed_chunks(d.select("doc_id", "source", F.col("doc_id").alias("place"), short.alias("content")), sources)
    return out.select("doc_id", F.md5(F.col("content").cast("binary")).alias("hash"))


# 300 words and their full stops make more than 300 tokens: the first sentence is too long, so that 299 words or fewer stay
LICENSED_SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) % 3, 1) AS k,
  CASE WHEN length(text) < 100 THEN text ELSE repeat('word ', 299) || 'word. End.' END AS content FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM d WHERE k <> 0),
c AS (SELECT *, CASE WHEN k = 1 OR length(content) < 100 THEN content ELSE repeat('word ', 208) || 'word …' END AS kept FROM n WHERE k = 1 OR n <= 20)
SELECT doc_id, md5(kept) AS hash FROM c"""


def money_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts read back from prose made of prices."""
    p = table(spark, sf_dir, "part")
    prose = F.concat(F.lit("pays $"), F.format_number("p_retailprice", 2), F.lit(" or $ 12 in all"))
    found = X.money_in(prose)
    return p.select("p_partkey", found[0].alias("first_cents"), found[1].alias("second_cents"))


MONEY_SQL = "SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS first_cents, CAST(1200 AS BIGINT) AS second_cents FROM part"

QUERIES = {
    "dedupe_ranked": (dedupe_ranked, DEDUPE_SQL),
    "fuzzy_dedupe": (fuzzy_dedupe, None),
    "entity_link": (entity_link, None),
    "quote_grounding": (quote_grounding, None),
    "quotes_contained": (quotes_contained, CONTAINED_SQL),
    "page_windows": (page_windows, PAGE_WINDOWS_SQL),
    "uncovered_pages": (uncovered_pages, UNCOVERED_SQL),
    "normalized_text": (normalized_text, NORMALIZED_SQL),
    "token_counts": (token_counts, TOKEN_COUNTS_SQL),
    "html_to_markdown": (html_to_markdown, None),
    "chunk_pages": (chunk_pages, None),
    "content_hash_ids": (content_hash_ids, HASH_SQL),
    "incremental_index": (incremental_index, INCREMENTAL_SQL),
    "identifier_hits": (identifier_hits, None),
    "checksum_valid": (checksum_valid, CHECKSUM_SQL),
    "span_clusters": (span_clusters, SPAN_SQL),
    "excerpt_overrun": (excerpt_overrun, OVERRUN_SQL),
    "keyword_tags": (keyword_tags, TAGS_SQL),
    "facets": (facets, FACETS_SQL),
    "overlap_search": (overlap_search, OVERLAP_SQL),
    "substring_search": (substring_search, SUBSTRING_SQL),
    "benefit_search": (benefit_search, FIELD_SQL),
    "ranked_search": (ranked_search, RANKED_SQL),
    "vector_topk": (vector_topk, VECTOR_SQL),
    "hybrid_topk": (hybrid_topk, HYBRID_SQL),
    "licensed_chunks": (licensed_chunks, LICENSED_SQL),
    "index_statistics": (index_statistics, STATISTICS_SQL),
    "money_extracted": (money_extracted, MONEY_SQL),
}
