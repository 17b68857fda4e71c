"""Texts as streams of the characters that matter to a search, with the place each came from, and many needles at once."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

try:
    import ahocorasick
except ImportError:  # needles are then looked for one at a time
    ahocorasick = None


@functools.lru_cache(1 << 16)
def _fold(code: int) -> int:
    """The base of a letter or digit in lower case, always one character; 0 for all else."""
    c = chr(code)
    if not c.isalnum():
        return 0
    base = unicodedata.normalize("NFD", c)[:1].lower()[:1]
    return ord(base or c)


@functools.lru_cache(1 << 16)
def _lower(code: int) -> int:
    return ord(chr(code).lower()[:1] or chr(code))


_ASCII_FOLD = np.array([_fold(i) for i in range(128)], np.uint32)
_ASCII_LOWER = np.array([_lower(i) for i in range(128)], np.uint32)
_SPACES = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)
_MARKS = np.array([ord(c) for c in "().-"], np.uint32)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def string(of: np.ndarray) -> str:
    return of.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _mapped(of: np.ndarray, ascii_table: np.ndarray, fn) -> np.ndarray:
    out = ascii_table[np.minimum(of, 127)]
    other = np.flatnonzero(of > 127)
    if len(other):
        kinds, where = np.unique(of[other], return_inverse=True)
        out[other] = np.array([fn(int(k)) for k in kinds], np.uint32)[where]
    return out


def compact(text: str) -> tuple[str, np.ndarray]:
    """Letters and digits alone, lower case and without accents, and the place in ``text`` that each came from."""
    folded = _mapped(codes(text), _ASCII_FOLD, _fold)
    at = np.flatnonzero(folded)
    return string(folded[at]), at


def letters(text: str) -> str:
    """What ``compact`` leaves of a short text, without places."""
    return "".join(filter(str.isalnum, text)).lower() if text.isascii() else compact(text)[0]


def spaced(text: str) -> tuple[str, np.ndarray]:
    """Lower case with runs of white space as one blank, and places."""
    of = codes(text)
    blank = np.isin(of, _SPACES)
    at = np.flatnonzero(~(blank & np.append(False, blank[:-1])))
    return string(np.where(blank, 32, _mapped(of, _ASCII_LOWER, _lower))[at]), at


def unspaced(text: str) -> tuple[str, np.ndarray]:
    """The text without white space and the marks that part the digits of a number, and places."""
    of = codes(text)
    at = np.flatnonzero(~(np.isin(of, _SPACES) | np.isin(of, _MARKS)))
    return string(of[at]), at


#: Letters that print takes for digits.
OCR_DIGITS = str.maketrans("oilsbz", "011582")


class Needles:
    """Finds all places of many strings, overlapping ones too, in one pass."""

    def __init__(self, needles: Iterable[str]):
        self.needles = sorted({n for n in needles if n})
        self.automaton = None
        if self.needles and ahocorasick:
            self.automaton = ahocorasick.Automaton()
            for n in self.needles:
                self.automaton.add_word(n, n)
            self.automaton.make_automaton()

    def places(self, stream: str) -> Iterator[tuple[str, int]]:
        """(needle, start)."""
        if self.automaton is not None:
            for end, needle in self.automaton.iter(stream):
                yield needle, end - len(needle) + 1
            return
        for needle in self.needles:
            start = stream.find(needle)
            while start >= 0:
                yield needle, start
                start = stream.find(needle, start + 1)
