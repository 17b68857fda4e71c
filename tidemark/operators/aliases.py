"""Aliases: hidden values become tokens, and tokens whose brackets print damaged become whole again, with their places."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.streams import Needles, compact, spaced, unspaced

#: Characters that a number may be written with, and digits that make it one.
NUMBER, NUMBER_DIGITS = r"[0-9\s().+-]+", 6
#: Fixed value: characters that a value must have.
LEAST = 2


class Aliases:
    """Replaces values by tokens: the leftmost first, of those that begin together the longest, whole words only.

    Words match in any case and with any white space between them, numbers with any of white space, brackets, dots and
    hyphens between their digits, and a bracket before. Of equal values the first one's token counts.
    """

    def __init__(self, aliases: Iterable[tuple[str, str]]):
        self.words: dict[str, tuple[int, int, str]] = {}
        self.numbers: dict[str, tuple[int, int, str]] = {}
        for order, (value, token) in enumerate(aliases):
            value = value.strip()
            if len(value) < LEAST:
                continue
            digits = "".join(c for c in value if "0" <= c <= "9")
            number = len(digits) >= NUMBER_DIGITS and re.fullmatch(NUMBER, value)
            held, key = (self.numbers, digits) if number else (self.words, spaced(value)[0])
            held.setdefault(key, (-len("".join(value.split())), order, token))
        self.streams = [(spaced, self.words, Needles(self.words)), (unspaced, self.numbers, Needles(self.numbers))]

    def _hits(self, text: str) -> Iterator[tuple[int, int, int, int, str]]:
        """(start, less the length without white space, order, end, token) of whole words."""
        for stream, held, needles in self.streams:
            if not held:
                continue
            chars, at = stream(text)
            for needle, i in needles.places(chars):
                a, b = int(at[i]), int(at[i + len(needle) - 1]) + 1
                if text[b : b + 1].isalnum():
                    continue
                bracket = held is self.numbers and text[a - 1 : a] == "(" and not text[max(0, a - 2) : a - 1].isalnum()
                if bracket:
                    a -= 1
                elif text[a - 1 : a].isalnum() and a:
                    continue
                size, order, token = held[needle]
                yield a, size, order, b, token

    def places(self, text: str) -> list[tuple[int, int, str]]:
        out, end = [], 0
        for a, _, _, b, token in sorted(self._hits(text)):
            if a >= end:
                out.append((a, b, token))
                end = b
        return out

    def apply(self, text: str, places: list[tuple[int, int, str]] | None = None) -> str:
        """The text with its values replaced; ``places`` if they are known already."""
        out, at = [], 0
        for a, b, token in self.places(text) if places is None else places:
            out += [text[at:a], token]
            at = b
        return "".join([*out, text[at:]])


def apply_aliases(docs: DataFrame, aliases: DataFrame, group: str, most: int = 100_000) -> DataFrame:
    """``docs`` with ``text`` replaced and ``replaced``, the places (start, end, token) in the text as it was.

    ``aliases`` has ``group``, value, token and order; a group's are one user's, at most ``most``, beyond which this fails
    rather than leave a value in. They are joined to the texts of their group; texts of groups without any stay.
    """
    many = aliases.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > most).limit(1).collect()
    if many:
        raise ValueError(f"{many[0].n} aliases in {group} {many[0][group]}: at most {most} can be applied at once")
    entry = F.struct("order", "value", "token")
    of = aliases.groupBy(group).agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("aliases"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        made = functools.lru_cache(64)(lambda j: Aliases((x["value"], x["token"]) for x in json.loads(j) if x.get("value") and x.get("token")))
        for pdf in frames:
            known = [made(j) if j else None for j in pdf.pop("aliases")]
            places = [k.places(t) if k and t else [] for k, t in zip(known, pdf["text"])]
            pdf["text"] = [k.apply(t, p) if p else t for k, t, p in zip(known, pdf["text"], places)]
            pdf["replaced"] = [[{"start": a, "end": b, "token": t} for a, b, t in p] for p in places]
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", replaced array<struct<start:int,end:int,token:string>>"
    return docs.join(of, group, "left").select(*docs.columns, "aliases").mapInPandas(run, schema)


#: Stems of alias tokens, the shape of whole ones, marks that print for their brackets, and those marks
#: that are brackets beyond doubt.
STEMS = (
    "CERTIFICATE", "MEMBERSHIP", "DEPENDENT", "PROVIDER", "EMPLOYER", "EMPLOYEE", "CONTRACT", "ACCOUNT", "ADDRESS", "COMPANY", "PATIENT", "MEMBER", "POLICY", "PERSON",
    "SPOUSE", "CLINIC", "DOCTOR", "GROUP", "CHILD", "PHONE", "EMAIL", "CARD", "CERT", "NAME", "PLAN", "DOB", "ORG", "ID",
)
WHOLE_TOKEN = r"\[[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\]"
OPENS, CLOSES = "[({|Il1!", "])}|Il1J!"
SURE_OPENS, SURE_CLOSES = "[({|", "])}|"

#: A token without its brackets. The suffix ends where a mark that may stand for a bracket, or anything but a word, begins.
_BODY = re.compile(
    rf"{WHOLE_TOKEN}|({'|'.join(STEMS)})([ ]?[_\-. ][ ]?|)([A-Z0-9]{{1,2}}?)(?=(?:[ ]?[{re.escape(CLOSES)}])?(?![A-Za-z0-9_]))"
)
_WORD = re.compile(r"[A-Za-z0-9_]")
#: How sure a mark is to be a bracket, by side: nothing there, a likeness, a bracket.
NONE, LIKE, SURE = range(3)
#: Which two marks make a token, whatever parts its stem from its suffix.
_ENOUGH = {(a, b) for a in range(3) for b in range(3) if SURE in (a, b) or (a, b) == (LIKE, LIKE)}


def _opening(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """(where the token begins, how sure its first mark is); None if a word goes on into the stem."""
    for gap in (0, 1):
        i = at - gap - 1
        blank = gap == 0 or text[at - 1 : at] == " "
        if blank and i >= floor and text[i] in OPENS and not (i and _WORD.match(text, i - 1)):
            return i, SURE if text[i] in SURE_OPENS else LIKE
    return None if at and _WORD.match(text, at - 1) else (at, NONE)


def _closing(text: str, at: int) -> tuple[int, int]:
    """(where the token ends, how sure its last mark is)."""
    for gap in (0, 1):
        i = at + gap
        blank = gap == 0 or text[at : at + 1] == " "
        if blank and text[i : i + 1] and text[i] in CLOSES and not _WORD.match(text, i + 1):
            return i + 1, SURE if text[i] in SURE_CLOSES else LIKE
    return at, NONE


def tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, whole token) of tokens, damaged or not: those with a bracket beyond doubt, an underscore, or something
    that stands for both brackets."""
    out, floor = [], 0
    for m in _BODY.finditer(text):
        if m.start() < floor:
            continue
        if m[1] is None:
            out.append((*m.span(), m[0]))
            floor = m.end()
            continue
        begins = _opening(text, m.start(), floor)
        if begins is None:
            continue
        ends = _closing(text, m.end())
        floor = ends[0]
        if (begins[1], ends[1]) in _ENOUGH or "_" in m[2]:
            out.append((begins[0], ends[0], f"[{m[1]}_{m[3]}]"))
    return out


class Repaired:
    """A text with its tokens made whole.

    Two arrays hold where its stretches, of text that stayed and of tokens in turn, begin in it and began in the text as it
    was; a place is looked up by search.
    """

    def __init__(self, text: str):
        self.found = tokens(text)
        parts, old, at = [], [], 0
        for a, b, token in self.found:
            parts += [text[at:a], token]
            old += [at, a]
            at = b
        parts.append(text[at:])
        self.text = "".join(parts)
        self.old = np.array([*old, at, len(text)], np.int64)
        self.new = np.cumsum([0, *map(len, parts)])

    @property
    def places(self) -> list[tuple[int, int]]:
        return list(zip(self.new[1:-1:2].tolist(), self.new[2:-1:2].tolist()))

    def original(self, place: int) -> int:
        """Where a place was in the text as it was; inside a changed token as far in as that one went."""
        if place >= len(self.text):
            return int(self.old[-1])
        i = int(np.searchsorted(self.new, place, "right")) - 1
        return int(min(self.old[i] + place - self.new[i], self.old[i + 1]))

    def share(self, start: int, end: int) -> float:
        """How much of a stretch lies in tokens."""
        inside = np.zeros(len(self.text) + 1, bool)
        for a, b in self.places:
            inside[a:b] = True
        return float(inside[start:end].mean()) if end > start else 0.0


def repair_aliases(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tokens): texts with whole tokens, and for each its place there and in the text as it was."""
    spans = "array<struct<token:string,start:int,end:int,was_start:int,was_end:int>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            all_made = [Repaired(t) if t else None for t in pdf["text"]]
            pdf["text"] = [r.text if r else t for r, t in zip(all_made, pdf["text"])]
            pdf["tokens"] = [
                [{"token": x, "start": c, "end": d, "was_start": a, "was_end": b} for (a, b, x), (c, d) in zip(r.found, r.places)] if r else [] for r in all_made
            ]
            yield pdf

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id bigint, text string, tokens {spans}")


@functools.cache
def _keys():
    @pandas_udf(StringType())
    def keys(values: pd.Series) -> pd.Series:
        known = {v: compact(v)[0] if v else "" for v in set(values)}
        return pd.Series([known[v] for v in values], dtype="object")

    return keys


def alias_book(assignments: DataFrame, book: str) -> DataFrame:
    """(book, token, kind, values, removed): what each token of a book stands for after all of its assignments.

    ``assignments`` has ``book``, order, token, kind and value. A value, told by its letters and digits, belongs to the token it
    was assigned to last; assigning it again to the one that has it changes nothing, and moving it takes it off the other. A
    token's values come in the order in which they came to stay, as they were written then; its kind is that of its first
    assignment. ``removed`` tokens had values and have none left. Values without letters or digits count for nothing.
    """
    rows = assignments.withColumn("__key", _keys()("value")).where("__key <> ''")
    of = Window.partitionBy(book, "__key").orderBy("order")
    came = F.lag("token").over(of).isNull() | (F.lag("token").over(of) != F.col("token"))
    moves = rows.withColumn("__came", came).where("__came")
    last = moves.groupBy(book, "__key").agg(F.max_by(F.struct("token", "order", F.trim("value").alias("value")), "order").alias("l"))
    entry = F.struct("l.order", "l.value")
    held = last.groupBy(book, F.col("l.token").alias("token")).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["value"]).alias("values"))
    every = rows.groupBy(book, "token").agg(F.min_by("kind", "order").alias("kind"))
    none = F.array().cast("array<string>")
    out = every.join(held, [book, "token"], "left")
    return out.select(book, "token", "kind", F.coalesce("values", none).alias("values"), F.col("values").isNull().alias("removed"))
