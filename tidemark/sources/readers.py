"""Readers and writers: line-delimited JSON with its errors, manifests, layout and receipt JSON, event-stream text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def jsonl_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, text) of the lines, from 1, that are no JSON of the schema; blank lines are none.

    Files are read in splits; a line's number is its place in its split after the lines of the file's splits before, of which
    only counts are shuffled.
    """
    told = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"))
    bad = lines.where((F.trim("value") != "") & told["_corrupt"].isNotNull())
    return bad.join(blocks, ["file", "block"]).select("file", (F.col("above") + F.col("id") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str, fail_fast: bool = False) -> DataFrame:
    """Rows of line-delimited JSON; ``_corrupt`` has the text of lines that can't be read. If they are to fail, all lines are
    looked at first, and the error names the first file and line."""
    if fail_fast:
        for r in jsonl_errors(spark, path, schema).orderBy("file", "line").limit(1).collect():
            raise ValueError(f"{r.file.rsplit('/', 1)[-1]}:{r.line}: no JSON of ({schema}): {r.text[:80]}")
        return spark.read.schema(schema).json(path)
    reader = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.option("mode", "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


_ID = re.compile(r"[a-z0-9][a-z0-9-]*")


def load_manifest(spark: SparkSession, text: str, only: Iterable[str] | None = None) -> DataFrame:
    """A YAML (or JSON) manifest of sources as rows (id, url, region, title, index, topics, verbatim, excerpt).

    Ids and urls must be unique, urls https; asking for an unknown id is an error.
    """
    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:
        found = json.loads(text)
    sources = found["sources"] if isinstance(found, dict) else found
    for key in ("id", "url"):
        values = [s[key] for s in sources]
        if len(set(values)) != len(values):
            raise ValueError(f"{key} is not unique")
    for s in sources:
        if not _ID.fullmatch(s["id"]) or not s["url"].startswith("https://"):
            raise ValueError(f"bad id or url: {s['id']}")
    wanted = set(only) if only is not None else {s["id"] for s in sources}
    if unknown := wanted - {s["id"] for s in sources}:
        raise KeyError(f"unknown sources: {sorted(unknown)}")
    rows = [
        (s["id"], s["url"], s.get("region"), s.get("title"), bool(s.get("index", True)), list(s.get("topics", [])),
         bool(s.get("reproduction", {}).get("verbatim", True)), bool(s.get("reproduction", {}).get("excerpt", True)))
        for s in sources if s["id"] in wanted
    ]
    schema = "id string, url string, region string, title string, index boolean, topics array<string>, verbatim boolean, excerpt boolean"
    return spark.createDataFrame(rows, schema)


LAYOUT = (
    "struct<content:string,pages:array<struct<pageNumber:int,spans:array<struct<offset:int,length:int>>,"
    "words:array<struct<content:string,span:struct<offset:int,length:int>,source:string,confidence:double>>>>>"
)
#: What parts pages where a layout lists none.
PAGE_BREAK = "<!-- PageBreak -->"


def _relative(spans: Column, offset: Column) -> Column:
    """Place in a page's text of a place in the whole content; null outside the page's spans."""
    start = F.struct(F.lit(0).alias("before"), F.lit(None).cast("int").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        inside = (offset >= s["offset"]) & (offset < s["offset"] + s["length"])
        at = F.when(acc["at"].isNull() & inside, acc["before"] + offset - s["offset"]).otherwise(acc["at"])
        return F.struct((acc["before"] + s["length"]).alias("before"), at.alias("at"))

    return F.aggregate(spans, start, step)["at"]


def layout_pages(df: DataFrame, column: str = "json") -> DataFrame:
    """Rows (page, text, words) of layout JSON: a page's text is its spans of the content, joined; without a list of pages the
    content is parted at page breaks. Words are (content, offset, length, polygon, confidence), offsets those in the page's
    text; words outside its spans are left out. A polygon is the numbers of ``D(page,x1,y1,...)``.
    """
    got = df.withColumn("__l", F.from_json(column, LAYOUT)).drop(column)
    word = "array<struct<content:string,span:struct<offset:int,length:int>,source:string,confidence:double>>"
    content = F.col("__l.content")
    parted = F.transform(
        F.split(content, f"\\Q{PAGE_BREAK}\\E"), lambda t, i: F.struct((i + 1).alias("page"), t.alias("text"), F.array().cast("array<struct<offset:int,length:int>>").alias("spans"), F.array().cast(word).alias("words"))
    )
    listed = F.transform(
        "__l.pages",
        lambda p: F.struct(
            p["pageNumber"].alias("page"), F.array_join(F.transform(p["spans"], lambda s: F.substring(content, s["offset"] + 1, s["length"])), "").alias("text"),
            p["spans"].alias("spans"), F.coalesce(p["words"], F.array().cast(word)).alias("words"),
        ),
    )
    pages = got.withColumn("__p", F.explode(F.when(F.size("__l.pages") > 0, listed).otherwise(parted)))
    numbers = lambda w: F.transform(F.split(F.regexp_extract(w["source"], r"^D\([0-9]+,(.*)\)$", 1), ","), lambda x: x.try_cast("double"))
    words = F.transform(
        "__p.words",
        lambda w: F.struct(
            w["content"].alias("content"), _relative(F.col("__p.spans"), w["span"]["offset"]).alias("offset"), w["span"]["length"].alias("length"),
            F.when(w["source"].rlike(r"^D\("), numbers(w)).alias("polygon"), w["confidence"].alias("confidence"),
        ),
    )
    return pages.withColumns({"page": F.col("__p.page"), "text": F.col("__p.text"), "words": F.filter(words, lambda w: w["offset"].isNotNull())}).drop("__l", "__p")


#: A field's members, in the order in which they are looked at.
MEMBERS = ("valueString", "valueDate", "valueNumber", "valueInteger", "valueBoolean", "valueTime")


def typed_value(field: Column) -> Column:
    """A field's value from the first of its typed members that is there, as text."""
    return F.coalesce(*[field[m].cast("string") for m in MEMBERS])


def _cents(text: Column) -> Column:
    """Cents of amounts, halves up; of negative ones too."""
    return F.round(F.trim(F.translate(text, "$,", "")).try_cast("decimal(20,6)") * 100).cast("bigint")


def parse_money(text: Column) -> Column:
    """Cents of amounts like ``$1,234.50``, halves up; null if there is no number or a negative one."""
    cents = _cents(text)
    return F.when(cents >= 0, cents)


_LEAF = "struct<valueString:string,valueDate:string,valueNumber:double,valueInteger:bigint,valueBoolean:boolean,valueTime:string,confidence:double>"
_LINE = f"struct<valueObject:struct<serviceDate:{_LEAF},description:{_LEAF},itemCode:{_LEAF},quantity:{_LEAF},amount:{_LEAF}>>"
#: A receipt's fields and what they are called when read.
RECEIPT_FIELDS = {
    "currency": "currency", "providerName": "providerName", "providerType": "providerType", "providerRegistrationNo": "providerRegistrationNo",
    "total": "totalCents", "insurerPaid": "insurerPaidCents",
}
LINE_FIELDS = {"serviceDate": "serviceDate", "description": "description", "itemCode": "itemCode", "quantity": "quantity", "amount": "amountCents"}
RECEIPT = "struct<" + ",".join(f"{n}:{_LEAF}" for n in RECEIPT_FIELDS) + f",serviceLines:struct<valueArray:array<{_LINE}>>>"
DOLLAR_SIGNS = ("$", "DOLLAR", "DOLLARS", "C$", "CA$", "A$", "AU$", "")


def parse_receipts(df: DataFrame, column: str = "json", region: str = "CA", low: float = 0.6) -> DataFrame:
    """Adds what a receipt's JSON says: provider_name, provider_type, provider_no, total_cents, insurer_paid_cents, currency,
    lines, confidence (map by field, lines by number), missing, issues (code, field).

    A currency that is only a dollar sign, or not there, is the region's, and told of as assumed. ``insurerPaidCents`` is
    never missing: most receipts lack it. Issues: ``assumed_default``, ``field_missing``, and ``low_confidence`` by name.
    """
    # two mentions of the text keep what makes it in a step of its own, which is compiled; what is inside from_json is interpreted
    df = df.withColumn("__f", F.when(F.col(column).isNotNull(), F.from_json(column, RECEIPT)))
    f = F.col("__f")
    rows = F.coalesce(f["serviceLines"]["valueArray"], F.array().cast(f"array<{_LINE}>"))
    entry = lambda name, c: F.when(c.isNotNull(), F.struct(name.alias("key"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)).alias("value")))

    # Spark interprets what a lambda or its array holds, each mention anew: what is needed twice is a column, or a member, first
    def told(x: Column, i: Column) -> Column:
        part = {n: typed_value(x["valueObject"][n]) for n in LINE_FIELDS}
        sure = [entry(F.concat(F.lit("serviceLines["), i.cast("string"), F.lit(f"].{t}")), x["valueObject"][n]["confidence"]) for n, t in LINE_FIELDS.items()]
        return F.struct(
            F.substring(part["serviceDate"], 1, 10).alias("day"), part["description"].alias("description"), part["itemCode"].alias("item_code"),
            part["quantity"].try_cast("double").alias("quantity"), _cents(part["amount"]).alias("cents"), F.array(*sure).alias("sure"),
        )

    def line(x: Column) -> Column:
        day = F.when(x["day"].rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), x["day"].try_cast("date"))
        return F.struct(
            day.alias("service_date"), x["description"].alias("description"), x["item_code"].alias("item_code"),
            F.when(x["quantity"] >= 0, x["quantity"]).alias("quantity"), F.when(x["cents"] >= 0, x["cents"]).alias("amount_cents"),
        )

    own = F.array(*[entry(F.lit(t), f[n]["confidence"]) for n, t in RECEIPT_FIELDS.items()])
    df = df.withColumns({f"__{n}": typed_value(f[n]) for n in RECEIPT_FIELDS} | {"__own": own, "__lines": F.transform(rows, told)}).drop("__f", column)
    value = {n: F.col(f"__{n}") for n in RECEIPT_FIELDS}
    said = F.upper(F.trim(F.coalesce(value["currency"], F.lit(""))))
    assumed = said.isin(*DOLLAR_SIGNS)
    currency = F.when(said.isin("CAD", "AUD"), said).when(assumed, "CAD" if region == "CA" else "AUD")
    confidence = F.map_from_entries(F.array_compact(F.concat("__own", F.flatten("__lines.sure"))))
    lacking = [F.when(F.size("__lines") == 0, "serviceLines"), F.when(assumed | (F.coalesce(value["currency"], F.lit("")) == ""), "currency")]
    lacking += [F.when(F.coalesce(value[n], F.lit("")) == "", t) for n, t in RECEIPT_FIELDS.items() if n not in ("currency", "insurerPaid")]
    df = df.withColumns(
        {
            "provider_name": value["providerName"], "provider_type": value["providerType"], "provider_no": F.when(value["providerRegistrationNo"] != "", value["providerRegistrationNo"]),
            "total_cents": parse_money(value["total"]), "insurer_paid_cents": parse_money(value["insurerPaid"]), "currency": currency, "lines": F.transform("__lines", line),
            "confidence": confidence, "missing": F.array_compact(F.array(*lacking)),
        }
    ).drop("__own", "__lines", *[f"__{n}" for n in RECEIPT_FIELDS])
    issue = lambda code, name: F.struct(code.alias("code"), name.alias("field"))
    told = F.transform("missing", lambda m: issue(F.when((m == "currency") & F.col("currency").isNotNull(), "assumed_default").otherwise("field_missing"), m))
    unsure = F.transform(F.sort_array(F.map_keys(F.map_filter("confidence", lambda k, v: v < low))), lambda k: issue(F.lit("low_confidence"), k))
    return df.withColumn("issues", F.concat(told, unsure))


def encode_frames(df: DataFrame, event: str, data: str) -> Column:
    """One server-sent event a row."""
    return F.concat(F.lit("event: "), F.col(event), F.lit("\ndata: "), F.col(data), F.lit("\n\n"))


def parse_frames(df: DataFrame, column: str = "body") -> DataFrame:
    """Rows (frame, event, data): frames of event-stream text that have data, in order; data lines are joined by line feeds,
    comments left out."""
    text = F.regexp_replace(column, "\r\n?", "\n")
    frames = df.select("*", F.posexplode(F.split(text, "\n\n")).alias("frame", "__t")).where("trim(__t) <> ''")
    rows = F.split("__t", "\n")
    event = F.get(F.filter(rows, lambda r: r.startswith("event:")), F.lit(0))
    data = F.transform(F.filter(rows, lambda r: r.startswith("data:")), lambda r: F.regexp_replace(r, "^data: ?", ""))
    return frames.where(F.size(data) > 0).select(*df.columns, "frame", F.trim(F.substring(event, 7, 1000)).alias("event"), F.array_join(data, "\n").alias("data"))


def export_all(tables: dict[str, DataFrame], path: str, drop: dict[str, list[str]] | None = None) -> None:
    """Write each table as JSON, without the columns (images, aliases) that ``drop`` names."""
    for name, df in tables.items():
        df.drop(*(drop or {}).get(name, [])).write.mode("overwrite").json(f"{path}/{name}")
