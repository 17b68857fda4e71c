"""Labels of personal data in forms and letters, and the values that stand behind, under or below them.

All labels are one alternation, longest first at each place; those that are everyday words count only at the start of a
line or a column, with a colon or a column gap behind, which is part of their pattern. Lines are parted by line feeds,
columns by tabs.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple


class Label(NamedTuple):
    id: str
    pattern: str
    shape: str
    kind: str
    family: str | None
    strict: bool = False


#: Number words, and possessives.
_NO = r"(?:no\.?|number|num\.?|#|nbr\.?)"
_S = r"(?:'s|’s)?"
#: Labels with the shape of their value, its kind and the family of its tokens.
LABELS = (
    Label("member_name", rf"(?i:(?:plan\s+|primary\s+|principal\s+)?member{_S}\s+name|name\s+of\s+(?:the\s+)?(?:plan\s+)?member|employee{_S}\s+name|insured(?:\s+person)?{_S}\s+name|patient{_S}\s+name|policy\s*holder{_S}(?:\s+name)?|card\s*holder{_S}(?:\s+name)?|principal\s+member|primary\s+member|plan\s+member|full\s+name|claimant{_S}\s+name)", "name", "member", "MEMBER"),
    Label("dependant_name", rf"(?i:(?:spouse|partner|dependa?e?nt|child){_S}\s+name)", "name", "member", "MEMBER"),
    Label("name_generic", r"(?i:name|member|insured|patient|claimant|surname|(?:first|last|given|family)\s+names?|spouse|partner|dependa?e?nt|child)", "name", "member", "MEMBER", True),
    Label("certificate", rf"(?i:certificate\s*(?:{_NO}|id)?|cert\.?\s*{_NO}|member\s*(?:id|{_NO})|employee\s*(?:id|{_NO})|id\s*{_NO}|identification\s+{_NO}|card\s*{_NO})", "id", "policy", "CERT"),
    Label("policy", rf"(?i:(?:group\s+)?(?:policy|plan|contract)\s*(?:{_NO}|id)|(?:group|division|membership)\s*(?:{_NO}|id)|group\s+(?:policy|plan|contract))", "id", "policy", "POLICY"),
    Label("reference", rf"(?i:(?:client|customer|reference|claim|account\s+holder)\s*(?:{_NO}|id)|ref\.?\s*{_NO})", "id", "identifier", "ID"),
    Label("dob", r"(?i:date\s+of\s+birth|birth\s*date|d\.?\s?o\.?\s?b\.?|born)", "date", "identifier", None),
    Label("employer", rf"(?i:employer{_S}(?:\s+name)?|plan\s+sponsor|company\s+name|organi[sz]ation\s+name)", "org", "employer", "EMPLOYER"),
    Label("address", r"(?i:(?:home|mailing|residential|street|postal|member|patient)\s+address|address)", "line", "address", "ADDRESS", True),
    Label("phone", rf"(?i:(?:home\s+|work\s+|daytime\s+)?(?:tel(?:ephone)?|phone|mobile|cell)(?:\s*{_NO})?)", "phone", "phone", "PHONE", True),
    Label("email", r"(?i:e-?mail(?:\s+address)?)", "email", "email", "EMAIL", True),
    Label("sin", rf"(?i:social\s+insurance\s*(?:{_NO})?)", "id", "identifier", "ID"),
    Label("sin_acronym", r"S\.?I\.?N\.?", "id", "identifier", "ID"),
    Label("health", rf"(?i:(?:personal\s+)?health\s+(?:card|insurance|services?|care)?\s*{_NO}|health\s+number|medicare\s*(?:card\s*)?(?:{_NO})?|individual\s+healthcare\s+identifier|tax\s+file\s*(?:{_NO})?)", "id", "identifier", "ID"),
    Label("health_acronym", rf"(?:OHIP|PHN|IHI|RAMQ|TFN|HCN)(?:\s*{_NO})?", "id", "identifier", "ID"),
    Label("bank", rf"(?i:(?:bank\s+)?account\s*{_NO}|BSB(?:\s*{_NO})?|transit\s*{_NO}|institution\s*{_NO})", "id", "identifier", None),
)
BY_ID = {x.id: x for x in LABELS}
#: What may stand between a label and its value, and how far a label reaches.
CONNECTOR = r"[ \t:#.\-–—]*(?:\((?:if\s+any|optional)\))?[ \t:#.\-–—]*"
REACH = 24


def _capitals() -> str:
    """A class of all capital letters of the basic plane, by ranges."""
    out: list[list[int]] = []
    for c in (i for i in range(0x10000) if unicodedata.category(chr(i)) == "Lu"):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out) + "]"


#: Shapes of values, and names of months.
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?"
_U, _L = _capitals(), r"[^\W\d_]"
SHAPES = {
    "name": rf"(?:(?:[Mm]rs?|[Mm][sx]|[Mm]iss|[Dd]r)\.?\s+)?{_U}(?:{_L}|['’.-])*(?:,?\s{{1,2}}{_U}(?:{_L}|['’.-])*){{0,4}}",
    "id": r"[A-Z]{0,4}[ -]?[0-9][0-9A-Z]*(?:[ \-/.]?[0-9A-Z]*[0-9][0-9A-Z]*)*(?:[ -][A-Z]{1,2}(?![^\W_]))?",
    "date": rf"(?i:[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}|[0-9]{{1,2}}[-/. ][0-9]{{1,2}}[-/. ][0-9]{{2,4}}|[0-9]{{1,2}}\s+{_MONTH},?\s+[0-9]{{4}}|{_MONTH}\s+[0-9]{{1,2}},?\s+[0-9]{{4}})",
    "org": rf"(?:{_U}|\d)[^\n\t]{{1,79}}",
    "line": r"[^\W_][^\n\t]{3,119}|#[^\n\t]{3,119}",
    "phone": r"\+?\(?[0-9][0-9 ()\-.]{5,}[0-9]",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
}
#: Words that begin another field, and words that end a name.
FIELD_WORDS = frozenset(
    "policy group certificate cert plan member members date birth employee employer id number no address phone telephone email effective coverage class division relationship role details type spouse partner dependant dependent child status province state postcode postal signature sin medicare health account bsb page section benefit benefits name".split()
)
NAME_ENDS = frozenset(("and", "or", "the", "of"))
#: How sure a value of a shape is, a label being there.
SURE = {"name": 0.7, "id": 0.72, "date": 0.8, "org": 0.65, "line": 0.65, "phone": 0.75, "email": 0.8}


class Found(NamedTuple):
    start: int
    end: int
    label: str


class Value(NamedTuple):
    label: str
    start: int
    end: int
    where: str  # beside, under or column


@functools.cache
def _scanner() -> tuple[re.Pattern, re.Pattern, dict[str, re.Pattern]]:
    """Where a label may begin, what label that is by looking ahead for all, connectors, and shapes."""
    one = lambda x: rf"(?=(?P<{x.id}>(?:{x.pattern})(?![^\W_]){r'(?=\s{0,3}[:\t])' if x.strict else ''}))?"
    ahead = re.compile("".join(one(x) for x in LABELS))
    begins = "|".join(f"[{c}{c.upper()}](?i:{rest})" for c, rest in _BEGINS.items())
    first = re.compile(rf"(?<![^\W_])(?={begins})")
    return first, ahead, {k: re.compile(p) for k, p in SHAPES.items()}


#: Letters that labels begin with, and by them how they go on, so that other places need no look.
_INITIALS = frozenset("abcdefghimnoprstPpOoIiRrTtHhSsBb")
_BEGINS = {
    "a": "cco|ddr", "b": "irt|orn|ank|sb", "c": "ard|lai|hil|ert|ont|lie|ust|omp|ell", "d": r"epe|ivi|ate|ayt|\.?\s?o\.?\s?b", "e": "mpl|-?mail", "f": "ull|irs|ami",
    "g": "ive|rou", "h": "ome|eal|cn", "i": "nsu|d|ndi|hi|nst", "m": "emb|ail|obi|edi", "n": "ame", "o": "rga|hip", "p": "lan|ri[mn]|ati|oli|art|ost|hon|ers|hn",
    "r": "ef|esi|amq", "s": r"pou|urn|tre|oci|\.?i\.?n", "t": "el|ax|fn|ran",
}


def found(text: str) -> list[Found]:
    """Labels of a text: the earliest first, of those that begin together the longest, none over another."""
    first, ahead, _ = _scanner()
    out, end = [], 0
    for m in first.finditer(text):
        at = m.start()
        if at < end or text[at].lower() not in _INITIALS:
            continue
        spans = [(x.end(g) - at, g) for x in (ahead.match(text, at),) for g in BY_ID if x[g]]
        opens = at == 0 or not text[max(text.rfind("\n", 0, at), text.rfind("\t", 0, at)) + 1 : at].strip()
        spans = [(n, g) for n, g in spans if n and (opens or not BY_ID[g].strict)]
        if spans:
            n, g = max(spans, key=lambda s: s[0])
            end = at + n
            out.append(Found(at, end, g))
    return out


@functools.cache
def _connector() -> re.Pattern:
    return re.compile(CONNECTOR, re.I)


def label_before(labels: list[Found], text: str, start: int, ids: tuple[str, ...]) -> bool:
    """Whether one of some labels ends at most ``REACH`` before a place, with nothing but a connector between."""
    lo = bisect.bisect_left(labels, start - REACH, key=lambda x: x.end)
    hi = bisect.bisect_right(labels, start, key=lambda x: x.end)
    return any(x.label in ids and _connector().fullmatch(text, x.end, start) for x in labels[lo:hi])


def _shaped(text: str, start: int, end: int, shape: str) -> tuple[int, int] | None:
    """The value of a shape at the beginning of a stretch, if it is one."""
    m = _scanner()[2][shape].match(text, start, end)
    if not m:
        return None
    value = m[0]
    if shape in ("name", "org"):
        for word in re.finditer(r"[^\s,]+", value):
            w = word[0].rstrip(".,").lower()
            if w in FIELD_WORDS or (shape == "name" and word.start() and w in NAME_ENDS):
                value = value[: word.start()]
                break
    value = value.rstrip(" \t\r\n\f\v,;:.")
    good = {
        "id": sum("0" <= c <= "9" for c in value) >= 3,
        "name": re.search(rf"{_L}{{2}}", value) is not None,
        "line": any(c.isdecimal() for c in value) or len(value) >= 8,
    }
    return (start, start + len(value)) if value and good.get(shape, True) else None


def _cells(text: str, line: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the columns of the line that begins at a place."""
    stop = text.find("\n", line)
    stop = len(text) if stop < 0 else stop
    while line <= stop:
        end = text.find("\t", line, stop)
        end = stop if end < 0 else end
        yield line, end
        line = end + 1


def _below(text: str, label: Found, shape: str) -> Iterator[tuple[int, int]]:
    """Values under a column's header: the cell of the same number in each line that follows, until one is missing or of
    another shape; forty lines at most."""
    line = text.rfind("\n", 0, label.start) + 1
    header = list(_cells(text, line))
    if len(header) < 2:
        return
    number = next(i for i, (a, b) in enumerate(header) if a <= label.start <= b)
    for _ in range(40):
        line = text.find("\n", line) + 1
        cells = list(_cells(text, line)) if line else []
        if len(cells) <= number:
            return
        a, b = cells[number]
        while a < b and text[a] == " ":
            a += 1
        value = _shaped(text, a, b, shape)
        if not value:
            return
        yield value


def values(text: str) -> list[Value]:
    """What labels give: the value behind a label, over a column gap too; in the next line if the label ends its line; or, of
    dates and numbers, all values of the column below."""
    out = []
    for x in found(text):
        shape = BY_ID[x.label].shape
        at = x.end
        # a full stop is no connector here: it ends a sentence
        while at < len(text) and text[at] in " \t:#-–—":
            at += 1
        where = "beside"
        if text[at : at + 1] == "\n":
            where, at = "under", at + 1
            while text[at : at + 1] == " ":
                at += 1
        ends = [e for e in (text.find("\n", at), text.find("\t", at)) if e >= 0]
        value = _shaped(text, at, min(ends, default=len(text)), shape)
        if value:
            out.append(Value(x.label, *value, where))
        elif shape in ("date", "id"):
            out += [Value(x.label, *v, "column") for v in _below(text, x, shape)]
    return out
