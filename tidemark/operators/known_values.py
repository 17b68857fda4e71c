"""Known values: the ways they are written, their places in documents, and values learned from labels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.streams import OCR_DIGITS, Needles, compact, letters
from ..sources.scratch import Scratch, checkpointed
from .joins import bounded

#: Titles that are no part of a name.
TITLES = frozenset("mr mrs ms mx miss dr prof".split())
#: Words of addresses and their short forms.
STREET_WORDS = {
    "street": "st", "avenue": "ave", "road": "rd", "drive": "dr", "boulevard": "blvd", "court": "ct", "crescent": "cres", "place": "pl", "lane": "ln",
    "terrace": "tce", "highway": "hwy", "parade": "pde", "circuit": "cct", "close": "cl", "apartment": "apt", "suite": "ste", "north": "n", "south": "s",
    "east": "e", "west": "w",
}
_LONG_WORDS = {short: long for long, short in STREET_WORDS.items()}
#: What goes before a national number, in place of what.
PHONE_PREFIXES = (("1", ""), ("61", "0"))


class Known(NamedTuple):
    value: str
    kind: str = "custom"
    is_name: bool = False
    token: str | None = None


class Way(NamedTuple):
    """One way a known value is written; ``part`` if it is only a piece of it."""

    text: str
    part: bool


def _streets(text: str, words: dict[str, str]) -> str:
    """Each word that the table has replaced; a full stop after it goes, other marks stay."""

    def swap(m: re.Match) -> str:
        other = words.get(m[1].lower())
        return m[0] if other is None else other + m[2].removeprefix(".")

    return re.sub(r"(\S*?)([.,;]*)(?=\s|$)", swap, text)


def _name_ways(value: str) -> Iterator[Way]:
    names = [w.rstrip(".,") for w in re.split(r"[\s,]+", value) if w and w.rstrip(".").lower() not in TITLES]
    if len(names) < 2:
        return
    *given, last = names
    yield Way(f"{given[0]} {last}", False)
    yield Way(f"{last} {given[0]}", False)
    yield Way(f"{last} {' '.join(given)}", False)
    yield from (Way(n, True) for n in names if len(letters(n)) >= 2)


def _address_ways(value: str) -> Iterator[Way]:
    pieces = [p.strip() for p in re.split(r"[,\n]+", value)]
    for text, part in [(value, False), *((p, True) for p in pieces if len(letters(p)) >= 6)]:
        for way in (text, _streets(text, _LONG_WORDS), _streets(text, STREET_WORDS)):
            yield Way(way, part)


def _phone_ways(value: str) -> Iterator[Way]:
    d = re.sub(r"[^0-9]", "", value)
    for abroad, home in PHONE_PREFIXES:
        if len(d) == 11 and d.startswith(abroad):
            yield Way(home + d[len(abroad) :], False)
        # ten digits at home: with the prefix in front, in place of the zero where there is one
        if len(d) == 10 and d.startswith("0") == bool(home):
            yield Way(abroad + d[len(home) :], False)


def ways(known: Known) -> list[Way]:
    """All ways of a value, each once by its letters and digits."""
    value = known.value.strip()
    out = [Way(value, False)]
    if known.is_name:
        out += _name_ways(value)
    if known.kind == "address":
        out += _address_ways(value)
    if known.kind == "phone":
        out += _phone_ways(value)
    first: dict[tuple[str, bool], Way] = {}
    for w in out:
        first.setdefault((letters(w.text), w.part), w)
    return [w for (plain, _), w in first.items() if plain]


class Hit(NamedTuple):
    start: int
    end: int
    known: Known
    part: bool


def _minds(edge: str, beside: str) -> bool:
    """Whether a character beside a value's edge goes on with it: digits mind digits, letters letters."""
    digit = lambda c: "0" <= c <= "9"
    return digit(beside) if digit(edge) else beside.isalpha()


class Finder:
    """Finds known values in texts, whatever their case, accents, marks and spaces; all places, overlapping ones too."""

    def __init__(self, values: Iterable[Known]):
        self.by_needle: dict[str, list[tuple[Known, Way]]] = {}
        for k in dict.fromkeys(values):
            for w in ways(k):
                needle = letters(w.text)
                if len(needle) >= 2:
                    self.by_needle.setdefault(needle, []).append((k, w))
        self.plain = Needles(self.by_needle)
        # long numbers are looked for among letters that print takes for digits
        self.printed: dict[str, list[str]] = {}
        for n in self.by_needle:
            if sum(c.isdecimal() for c in n) >= 6:
                self.printed.setdefault(n.translate(OCR_DIGITS), []).append(n)
        self.folded = Needles(self.printed)

    def _needles(self, stream: str, ocr: bool) -> Iterator[tuple[str, int]]:
        numbers = {n for v in self.printed.values() for n in v} if ocr else ()
        yield from ((n, at) for n, at in self.plain.places(stream) if n not in numbers)
        if ocr:
            for folded, at in self.folded.places(stream.translate(OCR_DIGITS)):
                yield from ((n, at) for n in self.printed[folded])

    def hits(self, text: str | None, ocr: bool = False) -> list[Hit]:
        if not text:
            return []
        stream, at = compact(text)
        out = set()
        for needle, i in self._needles(stream, ocr):
            a, b = int(at[i]), int(at[i + len(needle) - 1]) + 1
            if _minds(needle[0], text[a - 1 : a]) or _minds(needle[-1], text[b : b + 1]):
                continue
            for known, way in self.by_needle[needle]:
                lead, trail = (re.search(p, way.text.strip())[0] for p in (r"^[^\w\s]*", r"[^\w\s]*$"))
                start = a - len(lead) if lead and text.startswith(lead, max(0, a - len(lead)), a) else a
                end = b + len(trail) if text.startswith(trail, b) else b
                raw = text[start:end]
                # no value is put together over columns, or lines far apart
                if "\t" not in raw and raw.count("\n") < 2 and len(raw) <= 2 * len(way.text) + 4:
                    out.add(Hit(start, end, known, way.part))
        return sorted(out, key=lambda h: (h.start, -h.end, h.part, h.known.value, h.known.token or ""))


SPANS = "doc_id bigint, start int, end int, value string, kind string, token string, part boolean, known string"


def _rows(doc: object, text: str | None, finder: Finder, ocr: bool) -> Iterator[tuple]:
    for h in finder.hits(text, ocr):
        yield doc, h.start, h.end, text[h.start : h.end], h.known.kind, h.known.token, h.part, h.known.value


#: How many hits leave a task at once.
AT_ONCE = 20_000


def in_frames(found: Iterator[list[tuple]], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of one text after another, as frames that are let go from ``AT_ONCE`` rows on, however many texts come at once."""
    rows: list[tuple] = []
    for some in found:
        rows += some
        if len(rows) >= AT_ONCE:
            yield pd.DataFrame(rows, columns=names)
            rows = []
    yield pd.DataFrame(rows, columns=names)


def find_known(docs: DataFrame, known: DataFrame, group: str, ocr: str | None = None, most: int = 10_000) -> DataFrame:
    """(doc_id, start, end, value, kind, token, part, known): all places in the texts of a group of what is known in it.

    ``known`` has ``group``, value, kind, is_name and token. If its rows are at most ``most``, every task gets them once.
    Else documents and values meet by group, in parts of some values and blocks of some documents; as all hits count, those of
    parts add up to those of the whole. ``ocr`` names a column that is true for texts read from print. Null texts have no hits.
    """
    columns = [group, *Known._fields]
    known = known.select(*columns).distinct()
    docs = docs.select("doc_id", group, "text", (F.col(ocr) if ocr else F.lit(False)).alias("ocr"))
    names = [c.split()[0] for c in SPANS.split(", ")]
    held = known.limit(most + 1).collect()
    if len(held) <= most:
        by_group: dict[object, list[Known]] = {}
        for g, *k in held:
            by_group.setdefault(g, []).append(Known(*k))
        shared = docs.sparkSession.sparkContext.broadcast(by_group)

        def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            finders: dict[object, Finder] = {}

            def found() -> Iterator[list[tuple]]:
                for pdf in frames:
                    for doc, g, text, o in pdf.itertuples(index=False):
                        if g in shared.value:
                            if g not in finders:
                                finders[g] = Finder(shared.value[g])
                            yield _rows(doc, text, finders[g], bool(o))

            yield from in_frames(found(), names)

        return docs.mapInPandas(look, SPANS)
    return _in_blocks(docs, known, group)


#: How many values of a group are looked for at once, and in how many documents: both are bounds of a task's memory and of how
#: often values are made ready.
VALUES_AT_ONCE, DOCS_AT_ONCE = 50_000, 20_000


def _in_blocks(docs: DataFrame, known: DataFrame, group: str) -> DataFrame:
    """``find_known`` of any number of values: those of a part of a group and the documents of a block of it meet in one stream,
    values first, so that they are made ready once a block."""
    key = F.to_json(F.struct(F.col(group).alias("g"))).alias("key")  # nulls are a group too
    docs, known = docs.select(key, "doc_id", "text", "ocr"), known.select(key, *Known._fields)
    many = lambda df, most, name: df.groupBy("key").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = bounded(many(known, VALUES_AT_ONCE, "parts").join(many(docs, DOCS_AT_ONCE, "blocks"), "key"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    held = known.join(sizes, "key").select(
        "key", dealt("value", "parts").alias("part"), every("blocks").alias("block"), F.lit(0).alias("turn"), F.lit(0).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.lit(None).cast("string").alias("text"), F.lit(False).alias("ocr"), *Known._fields,
    )
    none = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in Known._fields]
    asked = docs.join(sizes, "key").select(
        "key", every("parts").alias("part"), dealt("doc_id", "blocks").alias("block"), F.lit(1).alias("turn"), "doc_id", "text", F.coalesce("ocr", F.lit(False)).alias("ocr"), *none
    )
    at = ["key", "part", "block"]
    rows = held.unionByName(asked).repartition(*at).sortWithinPartitions(*at, "turn")

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[list[tuple]]:
            now, values, finder = None, [], None
            for pdf in frames:
                for k, part, block, turn, doc, text, o, *value in pdf.itertuples(index=False):
                    if now != (k, part, block):
                        now, values, finder = (k, part, block), [], None
                    if not turn:
                        values.append(Known(*value))
                        continue
                    finder = finder or Finder(values)
                    yield list(_rows(doc, text, finder, bool(o)))

        yield from in_frames(found(), [c.split()[0] for c in SPANS.split(", ")])

    return rows.mapInPandas(apply, SPANS)


def learned(docs: DataFrame, group: str) -> DataFrame:
    """(group, value, kind, is_name, token): what labels give in the texts of each group, each once, as known values."""
    kind = docs.schema[group].dataType.simpleString()

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for g, t in zip(pdf[group], pdf["text"]):
                for v in labels.values(t or ""):
                    label = labels.BY_ID[v.label]
                    rows.append((g, t[v.start : v.end], label.kind, label.kind == "member", label.family))
            yield pd.DataFrame(rows, columns=[group, *Known._fields])

    return docs.select(group, "text").mapInPandas(learn, f"{group} {kind}, value string, kind string, is_name boolean, token string").distinct()


def learn_and_find(docs: DataFrame, group: str, most: int = 10_000) -> DataFrame:
    """Two passes: what a label gives in any document of a group is found, labelled or not, in all of them."""
    with Scratch(docs.sparkSession) as kept:  # texts are searched for labels once
        return checkpointed(find_known(docs, kept.keep(learned(docs, group)), group, most=most))
