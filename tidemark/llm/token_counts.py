"""Token counts by count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary's pieces in the text; dynamic programming keeps, for each position, the best
score and how many pieces it took, never the pieces. Rules are those of unigram tokenizers: of equal scores the one
whose last piece begins first stays; a character that no one-character piece covers is an unknown node of the least
score less 10, counted as its UTF-8 bytes where the vocabulary has byte pieces, else as one. No piece of the
vocabulary crosses from another character into a white-space mark, so that the text falls into segments of marks and
what follows, whose results add up and are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0


class ViterbiCounter(dict):
    """Remembers (pieces, score) of segments; ``remembered`` bounds its memory, not its results."""

    def __init__(self, pieces: dict[str, float], bytes_for_unknown: bool = True, remembered: int = 1_500_000):
        import ahocorasick

        super().__init__()
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece crosses into a white-space mark")
        self.find = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.find.add_word(p, (len(p), score))
        self.find.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.as_bytes, self.remembered = bytes_for_unknown, remembered
        self.segments = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    @classmethod
    def from_sentencepiece(cls, path: str) -> ViterbiCounter:
        """The pieces and scores of a model file, read as a unigram vocabulary."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        plain = [i for i in n if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        return cls({m.id_to_piece(i): m.get_score(i) for i in plain}, any(m.is_byte(i) for i in n))

    def __missing__(self, segment: str) -> tuple[int, float]:
        got = self.viterbi(segment)
        if len(segment) < 64:
            if len(self) >= self.remembered:
                self.clear()
            self[segment] = got
        return got

    def viterbi(self, segment: str) -> tuple[int, float]:
        """Pieces and score of the best path; matches come in order of their end, the longest first."""
        n = len(segment)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        if self.single.issuperset(segment):
            for end, (size, score) in self.find.iter(segment):
                to = end + 1
                at = to - size
                got, had = best[at] + score, best[to]
                if had is None or got > had:
                    best[to] = got
                    count[to] = count[at] + 1
            return count[n], best[n]
        matches = self.find.iter(segment)
        nxt = next(matches, None)
        for to in range(1, n + 1):
            while nxt is not None and nxt[0] + 1 == to:
                size, score = nxt[1]
                got = best[to - size] + score
                if best[to] is None or got > best[to]:
                    best[to], count[to] = got, count[to - size] + 1
                nxt = next(matches, None)
            c = segment[to - 1]
            if c not in self.single:
                got = best[to - 1] + self.unknown
                if best[to] is None or got > best[to]:
                    best[to] = got
                    count[to] = count[to - 1] + (len(c.encode()) if self.as_bytes else 1)
        return count[n], best[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a whole text, with the mark that tokenizers put before it; nothing for none."""
        if not text:
            return 0, 0.0
        pieces, total = 0, 0.0
        for p, s in map(self.__getitem__, self.segments.findall(MARK + text.replace(" ", MARK))):
            pieces += p
            total += s
        return pieces, total


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score): one row for each row; null and empty texts have no tokens. An empty table gives none.

    The vocabulary is read from ``model_path`` on each worker.
    """
    df = keyed_texts(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ViterbiCounter.from_sentencepiece(model_path)
        for b in batches:
            got = [counter.count(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.float64())],
                names=["doc_id", "n_tokens", "score"],
            )

    return df.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, score double")
