"""Text functions: normal forms, similarity scores, tags, token counts, extraction from prose."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Typographic marks and their plain forms, tags, and marks of markdown that stand for a space.
TYPOGRAPHIC = ("‘’“”–—\u00a0", "''\"\"-- ")
TAGS, MARKS = r"<[^>]+>", r"[|*#`>~]+"


def normalize_ascii(text: Column) -> Column:
    """Plain quotes and dashes, no tags nor markdown marks, single spaces, lower case: inside the JVM."""
    t = F.translate(text, *TYPOGRAPHIC)
    for pattern in (TAGS, MARKS, r"(?U)[\s\x1C-\x1F]+"):
        t = F.regexp_replace(t, pattern, " ")
    return F.lower(F.trim(t))


def normalize_text(text: str | None) -> str:
    """As ``normalize_ascii``, after compatibility composition."""
    t = unicodedata.normalize("NFKC", text or "").translate(str.maketrans(*TYPOGRAPHIC))
    return " ".join(re.sub(MARKS, " ", re.sub(TAGS, " ", t)).split()).lower()


@functools.cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition holds one ASCII character, and that; and those with several."""
    one, many = {}, {}
    for c in map(chr, (*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F))):
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if plain:
            (one if len(plain) == 1 else many)[c] = plain
    return "".join(one), "".join(one.values()), many


def ascii_text(text: Column) -> Column:
    """Accents off, ligatures and widths undone, as far as Latin scripts and signs go; other characters left out."""
    one, plain, many = _decompositions()
    out = F.translate(text, one, plain)
    # only texts with such a character at all are looked at for each
    pairs = F.array(*[F.struct(F.lit(c).alias("a"), F.lit(x).alias("b")) for c, x in many.items()])
    several = F.aggregate(pairs, out, lambda acc, p: F.replace(acc, p["a"], p["b"]))
    out = F.when(out.rlike("[" + "".join(many) + "]"), several).otherwise(out)
    return F.regexp_replace(out, r"[^\x00-\x7F]+", "")


def slug(text: Column, most: int = 48) -> Column:
    """ASCII slug; ``item`` if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.lower(ascii_text(text)), "[^a-z0-9]+", "-"), "(^-+)|(-+$)", "")
    t = F.regexp_replace(F.substring(t, 1, most), "-+$", "")
    return F.when(t == "", F.lit("item")).otherwise(t)


def distinct_list(text: Column) -> Column:
    """Parts of a list by commas, semicolons or lines, in order, each once."""
    parts = F.transform(F.split(text, r"[,;\n]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


#: Suffixes that similar names may differ in, in the order in which they are tried.
SUFFIXES = ("ations", "ation", "ists", "ist", "ics", "ic", "ors", "or", "ies", "y", "es", "s")


def stem(word: str) -> str:
    """The word without the first listed suffix that leaves four letters."""
    return next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) - len(s) >= 4), word)


def _lcs(a: str, b: str, masks: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit vectors; ``masks`` are the places of a's characters."""
    if masks is None:
        masks = {}
        for i, c in enumerate(a):
            masks[c] = masks.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        common = row & masks.get(c, 0)
        row = ((row + common) | (row - common)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths."""
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def _lcs_at(masks: np.ndarray, of: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Longest common subsequences of a text of ``n`` characters with the windows of ``n`` that begin at ``starts``, all at once:
    bit vectors in words of 64, with carries between them."""
    words = masks.shape[1]
    row = np.full((words, len(starts)), ~np.uint64(0))
    for k in range(n):
        mask = masks[of[starts + k]]
        carry = np.zeros(len(starts), np.uint64)
        for w in range(words):
            common = row[w] & mask[:, w]
            total = row[w] + common
            over = total < common
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            row[w] = total | (row[w] & ~common)
    tail = np.uint64((1 << (n - 64 * (words - 1))) - 1) if n % 64 else ~np.uint64(0)
    row[-1] |= ~tail
    return 64 * words - np.bitwise_count(row).sum(axis=0, dtype=np.int64)


def _lcs_of(short: str, masks: np.ndarray, of: np.ndarray, starts: np.ndarray, long: str) -> np.ndarray:
    """Common sequences with some windows: one after the other as whole numbers if they are few or very long, else all at once."""
    n = len(short)
    if len(starts) >= 48 and n <= 2048:
        return _lcs_at(masks, of, starts, n)
    held: dict[str, int] = {}
    for i, c in enumerate(short):
        held[c] = held.get(c, 0) | 1 << i
    return np.array([_lcs(short, long[max(0, s - n + 1) : s + 1], held) for s in starts.tolist()], np.int64)


def _shared_counts(of: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` of the numbers ``of``, how many of ``wanted`` it has, each as often as it is wanted."""
    out = np.zeros(len(of) - width + 1, np.int64)
    for number, times in zip(*np.unique(wanted, return_counts=True)):
        at = np.flatnonzero(of == number)
        if len(at) > 1:
            seen = np.zeros(len(of) + 1, np.int32)
            seen[at + 1] = 1
            np.cumsum(seen, out=seen)
            out += np.minimum(seen[width:] - seen[:-width], times)
        elif len(at):
            out[max(0, at[0] - width + 1) : at[0] + 1] += 1
    return out


def partial_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """The best ratio of the shorter text with a part of the longer one that is as long, or shorter at an end of it; 0 if none is
    above ``floor``.

    Exact: two things bound a part's ratio. The common sequence is at most what it shares with the shorter text whatever the
    order; and a character that is left out or put in changes three pairs of neighbours, and five runs of three, at most. And
    parts one place apart differ by one at most in what they have in common, so that some, spread out, bound those between.
    """
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, m = len(short), len(long)
    number = {c: i + 1 for i, c in enumerate(dict.fromkeys(short))}
    of = np.zeros(m + 2 * (n - 1), np.int64)
    of[n - 1 : n - 1 + m] = [number.get(c, 0) for c in long]
    starts = np.arange(m + n - 1)
    lengths = np.minimum(n, np.minimum(starts + 1, m + n - 1 - starts))
    own = np.array([number[c] for c in short], np.int64)
    bound, batch = 200.0 * lengths / (n + lengths), np.zeros(0, np.int64)
    if n >= 3:
        # at first by the runs of three of a part that the shorter text has at all; where they stand in both tells where to begin
        left, mine = ((x[:-2] * (len(number) + 1) + x[1:-1]) * (len(number) + 1) + x[2:] for x in (of, own))
        known, place = np.unique(mine, return_index=True)
        nearest = np.minimum(np.searchsorted(known, left), len(known) - 1)
        have = known[nearest] == left
        seen = np.concatenate([[0], np.cumsum(have)])
        apart = np.maximum((n - 2) + np.maximum(lengths - 2, 0) - 2 * (seen[n - 2 :] - seen[: 2 - n]), 0)
        bound = np.minimum(bound, 100.0 * (n + lengths - np.ceil(apart / 5)) / (n + lengths))
        if not (bound > floor).any():
            return 0.0
        votes = np.bincount(np.maximum(np.flatnonzero(have) - place[nearest[have]], 0), minlength=1)
        likely = [x for x in np.argsort(-votes, kind="stable")[:4].tolist() if votes[x]]
        batch = np.array(sorted({min(max(0, x + e), m + n - 2) for x in likely for e in (-1, 0, 1)}), np.int64)
    masks = np.zeros((len(number) + 1, -(-n // 64)), np.uint64)
    np.bitwise_or.at(masks, (own, np.arange(n) // 64), np.uint64(1) << (np.arange(n) % 64).astype(np.uint64))
    most = np.floor(bound * (n + lengths) / 200.0 + 1e-6).astype(np.int64)
    done = np.zeros(len(starts), bool)
    found, spread, counted = 0.0, n // 3, False
    while True:
        if len(batch):
            common = _lcs_of(short, masks, of, batch, long)
            found = max(found, float((200.0 * common / (n + lengths[batch])).max()))
            most[batch], done[batch] = common, True
            # from one part to the next a common sequence grows by one at most, either way
            most = np.minimum.accumulate(most - starts) + starts
            most = np.minimum.accumulate((most + starts)[::-1])[::-1] - starts
        left = np.flatnonzero(~done & (200.0 * most / (n + lengths) > max(found, floor)))
        if not len(left):
            return found if found > floor else 0.0
        if not counted and spread < n // 3 and len(left) > 48:
            # the runs of one, two and three characters of each part, each as often as the shorter text has it
            counted, batch = True, left[:0]
            bound = np.minimum(bound, 200.0 * _shared_counts(of, own, n) / (n + lengths))
            runs, mine = of, own
            for size in (2, 3):
                if n >= size and (bound > max(found, floor)).any():
                    runs = runs[:-1] * (len(number) + 1) + of[size - 1 :]
                    mine = mine[:-1] * (len(number) + 1) + own[size - 1 :]
                    both = _shared_counts(runs, mine, n - size + 1)
                    apart = np.maximum((n - size + 1) + np.maximum(lengths - size + 1, 0) - 2 * both, 0)
                    bound = np.minimum(bound, 100.0 * (n + lengths - np.ceil(apart / (2 * size - 1))) / (n + lengths))
            most = np.minimum(most, np.floor(bound * (n + lengths) / 200.0 + 1e-6).astype(np.int64))
            continue
        batch, spread = left[:: max(1, min(spread, len(left) // 16))], spread // 4


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Ratio of common words, with and without each side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join([*sorted(x & y), *sorted(s)]) for s in (x - y, y - x))
    if both and (x <= y or y <= x):
        return 100.0
    return max([ratio(one, two), *([ratio(both, one), ratio(both, two)] if both else [])])


def names_match(a: str | None, b: str | None) -> float:
    """0 to 100 likeness of two names, whatever their order of words and simple suffixes."""
    x, y = normalize_text(a), normalize_text(b)
    if not x or not y:
        return 0.0
    sx, sy = (" ".join(stem(w) for w in t.split()) for t in (x, y))
    return max(token_sort_ratio(x, y), token_set_ratio(x, y) - 5, token_sort_ratio(sx, sy))


def normal_score(quote: str, page: str, floor: float = 0.0) -> float:
    """100 if the page has the quote, else the best ratio with a part of it, 0 if none is above ``floor``; both in normal form."""
    return 0.0 if not quote or not page else 100.0 if quote in page else partial_ratio(quote, page, floor)


#: How many pieces of quotes are compared at once, in fewer pairs than what it doesn't pay.
LANES, FEWEST = 2048, 32


def least_edits(quotes: list[str], pages: list[str]) -> np.ndarray:
    """For each quote a bound from below of the edits (a character put in, left out or changed) that it takes to make it a part of
    its page: the sum of what its pieces of 64 characters take, each for itself. Pieces of many quotes go over their pages
    together, by bit vectors."""
    every = sorted(((k, q[i : i + 64]) for k, q in enumerate(quotes) for i in range(0, len(q), 64)), key=lambda x: len(pages[x[0]]))
    out = np.zeros(len(quotes), np.int64)
    one = np.uint64(1)
    at = 0
    while at < len(every):
        lanes = every[at : at + LANES]
        at += len(lanes)
        letters = {c: i for i, c in enumerate(dict.fromkeys("".join(piece for _, piece in lanes)))}
        width = len(letters) + 1  # the last stands for all other characters, and for what lies beyond a page's end
        row = {page: i for i, page in enumerate(dict.fromkeys(pages[k] for k, _ in lanes))}
        text = np.full((max(map(len, row)), len(row)), width - 1, np.int32)
        for page, i in row.items():
            text[: len(page), i] = [letters.get(c, width - 1) for c in page]
        of_row = np.array([row[pages[k]] for k, _ in lanes])
        sizes = np.array([len(piece) for _, piece in lanes])
        lane = np.repeat(np.arange(len(lanes)), sizes)
        place = np.arange(len(lane)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        masks = np.zeros(len(lanes) * width, np.uint64)
        np.bitwise_or.at(masks, lane * width + [letters[c] for _, piece in lanes for c in piece], one << place.astype(np.uint64))
        base, top = np.arange(len(lanes)) * width, (sizes - 1).astype(np.uint64)
        plus, minus = np.full(len(lanes), ~np.uint64(0)), np.zeros(len(lanes), np.uint64)
        now, least = sizes.copy(), sizes.copy()
        for here in text:
            same = masks[base + here[of_row]]
            across = (((same & plus) + plus) ^ plus) | same
            up, down = minus | ~(across | plus), plus & across
            now += ((up >> top) & one).astype(np.int64)
            now -= ((down >> top) & one).astype(np.int64)
            np.minimum(least, now, out=least)
            up, same = up << one, same | minus
            plus, minus = (down << one) | ~(same | up), up & same
        np.add.at(out, [k for k, _ in lanes], least)
    return out


def normal_scores(quotes: list[str], pages: list[str], floors: list[float]) -> list[float]:
    """``normal_score`` of many: quotes that take so many edits that no part of their page can score above the floor, of which
    each costs at least one of both lengths' characters, are told together."""
    hard = [k for k, (q, page, floor) in enumerate(zip(quotes, pages, floors)) if floor > 0 and 64 <= len(q) <= len(page) and q not in page]
    out: list[float | None] = [None] * len(quotes)
    if len(hard) >= FEWEST:
        edits = least_edits([quotes[k] for k in hard], [pages[k] for k in hard])
        for k, e in zip(hard, edits.tolist()):
            if 100.0 - 50.0 * e / len(quotes[k]) < floors[k] - 1e-6:
                out[k] = 0.0
    return [normal_score(*x) if known is None else known for known, x in zip(out, zip(quotes, pages, floors))]


def quote_score(quote: str | None, page: str | None) -> float:
    return normal_score(normalize_text(quote), normalize_text(page))


def grams(text: str, size: int = 3) -> list[str]:
    return [text[i : i + size] for i in range(len(text) - size + 1)]


def may_reach(quote: str, page_grams: set[str], least: float) -> bool:
    """Whether a page with these runs of three characters can have a part that is like the quote by ``least``, for pages at
    least as long as the quote.

    Let a part of n - t characters share l of the quote's n in order. To score r = least / 100 it takes l >= r (n - t / 2), and
    as l <= n - t, t <= n (1 - r) / (1 - r / 2). Each of the n - l characters that are missing is in three of the quote's runs,
    each of the n - t - l others that stand between those left parts two: at most 5 (1 - r) n + (2.5 r - 2) t runs are not the
    page's.
    """
    n, r = len(quote), least / 100
    lost = 5 * (1 - r) * n + max(0.0, 2.5 * r - 2) * n * (1 - r) / (1 - r / 2)
    need = n - 2 - math.floor(lost + 1e-9)
    return need <= 0 or sum(g in page_grams for g in grams(quote)) >= need


def scored(fn: Callable[[str | None, str | None], float]):
    """A vectorised UDF of two text columns that scores each distinct pair of a batch once."""

    @pandas_udf(T.DoubleType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        pairs = list(zip(a, b))
        for p in pairs:
            if p not in known:
                known[p] = fn(*p)
        return pd.Series([known[p] for p in pairs], dtype="float64")

    return udf


def token_count(text: Column) -> Column:
    """Approximate tokens: the more of words and marks, and a token for each 3.5 characters."""
    words = F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), 1))
    return F.greatest(words, F.ceil(F.length(text) / 3.5)).cast("bigint")


def scored1(fn: Callable[[str | None], str]):
    """A vectorised UDF of a text column to a text, made once for each distinct value of a batch."""

    @pandas_udf(T.StringType())
    def udf(a: pd.Series) -> pd.Series:
        known = {t: fn(t) for t in set(a)}
        return pd.Series([known[t] for t in a], dtype="object")

    return udf


def words_and_marks(text: str) -> int:
    return len(re.findall(r"\w+|[^\w\s]", text))


def tokens_of(marks: int, chars: int) -> int:
    """Tokens of a text from its words and marks, and its characters."""
    return max(marks, -(-chars * 2 // 7))


def count_tokens(text: str) -> int:
    return tokens_of(words_and_marks(text), len(text))


def tags(text: Column, table: dict[str, list[str]], most: int = 6, hints: Column | None = None) -> Column:
    """Hints, then tags whose keywords the text has: lower case, 40 characters at most, each once."""
    low = F.lower(text)
    found = [F.when(F.greatest(*[F.contains(low, F.lit(k)).cast("int") for k in [*keys, keys[0]]]) == 1, F.lit(tag)) for tag, keys in table.items()]
    every = F.array_compact(F.array(*found))
    if hints is not None:
        every = F.concat(F.coalesce(hints, F.array().cast("array<string>")), every)
    clean = F.transform(every, lambda t: F.substring(F.lower(F.trim(t)), 1, 40))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: t != "")), 1, most)


def snippet(text: Column, most: int = 480) -> Column:
    """White space collapsed, cut with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def chunk_id(source: Column, section: Column, content: Column) -> Column:
    """Id of a chunk: its source's, and the start of a digest of section and content."""
    digest = F.sha2(F.concat(section, F.lit("\n"), content).cast("binary"), 256)
    return F.concat_ws("-", source, F.substring(digest, 1, 20))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def letter_index(i: Column) -> Column:
    """0, 1, ... as A to Z, AA to ZZ, AAA and on, up to six letters."""
    i, out, first = i.cast("bigint"), None, 0
    for size in range(1, 7):
        place = [F.char((F.floor((i - first) / 26**k) % 26 + 65).cast("int")) for k in range(size - 1, -1, -1)]
        here = F.concat(*place)
        after = first + 26**size
        out = F.when(i < after, here) if out is None else out.when(i < after, here)
        first = after
    return out


def letter_number(letters: Column) -> Column:
    """The reverse of ``letter_index``."""
    codes = F.transform(F.regexp_extract_all(letters, F.lit("[A-Z]"), 0), lambda c: (F.ascii(c) - 64).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, x: acc * 26 + x) - 1


#: How amounts, dates and numbers are written in prose.
_GROUP = "[,\u2009\u202f\u00a0 ]"
MONEY = (
    rf"(?i)(?<![\w.])(?:(?:CA|AU|C|A)\$|\$)\s?(\d{{1,3}}(?:{_GROUP}\d{{3}})+|\d+)(?:\.(\d{{1,2}}))?(?!\d)"
    rf"|(?<![\w.$])(\d{{1,3}}(?:{_GROUP}\d{{3}})+|\d+)(?:\.(\d{{2}}))?\s?(?:dollars|CAD|AUD)\b"
)
_MONTH = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
DATES = (
    (r"\b(\d{4})-(\d{2})-(\d{2})\b", (1, 2, 3)),
    (rf"(?i)\b({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", (3, 1, 2)),
    (rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH})\.?,?\s+(\d{{4}})\b", (3, 2, 1)),
)
NUMBER = r"\d[\d,]*(?:\.\d+)?"


def _group(hit: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(hit, pattern, i), F.lit(""))


def money_in(text: Column) -> Column:
    """Cents of the amounts in prose, in order: after a dollar sign, or before the currency's name."""
    found = F.regexp_extract_all(text, F.lit(MONEY), 0)

    def cents(hit: Column) -> Column:
        units = F.coalesce(_group(hit, MONEY, 1), _group(hit, MONEY, 3))
        part = F.coalesce(_group(hit, MONEY, 2), _group(hit, MONEY, 4), F.lit("0"))
        return F.regexp_replace(units, "[^0-9]", "").try_cast("bigint") * 100 + F.rpad(part, 2, "0").cast("bigint")

    return F.transform(found, cents)


def dates_in(text: Column) -> Column:
    """Dates in prose, each once, sorted: ISO ones, and those with a month's name before or after the day."""
    months = F.array(*[F.lit(x) for x in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")])

    def found(pattern: str, y: int, m: int, d: int) -> Column:
        def day(hit: Column) -> Column:
            month = F.regexp_extract(hit, pattern, m)
            number = F.coalesce(month.try_cast("int"), F.array_position(months, F.lower(F.substring(month, 1, 3))).cast("int"))
            parts = [F.regexp_extract(hit, pattern, y), F.lpad(number.cast("string"), 2, "0"), F.lpad(F.regexp_extract(hit, pattern, d), 2, "0")]
            return F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd")

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), day)

    every = [found(pattern, *places) for pattern, places in DATES]
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*every))))


def numbers_in(text: Column) -> Column:
    """Numbers in prose, commas between thousands left out, each once, sorted."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), 0)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, ",", "").cast("double"))))


def fact_holds(kind: Column, text: Column, cents: Column, day: Column, tolerance: Column, number: Column, options: Column) -> Column:
    """Whether an answer states a fact: an amount, a date within so many days, a number, or one of several texts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    near = F.exists(dates_in(text), lambda d: F.abs(F.date_diff(d, day)) <= F.coalesce(tolerance, F.lit(0)))
    said = F.exists(options, lambda o: F.contains(low, F.lower(o)))
    holds = F.when(kind == "money", F.array_contains(money_in(text), cents)).when(kind == "date", near).when(kind == "number", F.array_contains(numbers_in(text), number)).when(kind == "text", said)
    return F.coalesce(holds, F.lit(False))


def fold_digits(text: Column) -> Column:
    """Digits that readers of print mistake for letters, as digits."""
    return F.translate(F.lower(text), "oilsbz", "011582")


def hash_vector(text: str, size: int = 64) -> np.ndarray:
    """A unit vector that the text alone decides."""
    import hashlib

    raw = b"".join(hashlib.sha256(f"{i}:{text}".encode()).digest() for i in range(-(-size // 16)))
    v = np.frombuffer(raw[: 2 * size], "<i2").astype(np.float64)
    return v / max(np.linalg.norm(v), 1e-12)


def parse_blank(text: Column) -> Column:
    """Null for texts of white space alone."""
    return F.when(F.trim(text) != "", text)
