"""Personal data: plain patterns, then a skip-chain conditional random field over each document.

Nodes are the tokens that could hold an identifier: those with a digit or an at sign, and those that repeat the local
part of an address found. Chain edges join neighbours; skip edges join each token to the next one, however far, that
repeats it or its last seven digits, so that links grow with the tokens, not with the square of a group. Loopy
sum-product passes messages over the documents of a slice at once; tokens under a pattern's match are held to its kind.
Tokens that reach ``sure`` for a kind and hold what it needs become spans too. Weights are fitted, factor by factor, on
sentences generated from a seed, so that they are the same wherever the model is made.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import keyed_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
CHAIN, SKIP = 0, 1
#: Words before a token that hint at its kind.
CUES = {
    "email": {"mail", "email", "e-mail", "contact", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "addr"},
    "card": {"card", "visa", "mastercard", "amex", "carte", "karte", "tarjeta", "cc"},
    "phone": {"phone", "call", "tel", "telephone", "mobile", "fax", "cell", "telefon", "ring"},
}

_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from an at sign back over the local part, as far as the match before."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            after = m.end()
        at = text.find("@", m.end() if m else at + 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[Span]:
    """Matches of the plain patterns, by kind, then start."""
    if not text or not _MARK.search(text):
        return []
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if text.count(".") >= 3:
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) < 4 and int(p) <= 255 for p in parts):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _key(token: str) -> str:
    return "".join(c for c in token.lower() if c.isalnum())


Node = tuple[int, int, str, str]  # start, end, token without edge punctuation, cue words before


def local_parts(text: str, base: list[Span]) -> set[str]:
    """Keys of the local parts, of four characters at least, of the addresses found."""
    local = {_key(text[a:b].split("@")[0]) for k, a, b in base if k == "email"}
    return {x for x in local if len(x) >= 4}


def nodes_of(text: str, local: set[str]) -> Iterator[Node]:
    """Candidate tokens of a text, in order."""

    def node(start: int, end: int) -> Iterator[Node]:
        raw = text[start:end]
        core = raw.strip(_EDGE)
        if core:
            at = start + raw.index(core)
            yield at, at + len(core), core, text[max(0, start - 40) : start].lower()

    if local:
        for m in _TOKEN.finditer(text):
            if _MARK.search(m[0]) or (len(m[0]) < 80 and _key(m[0]) in local):
                yield from node(*m.span())
        return
    at = 0
    while m := _MARK.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in " \t\n\r\v\f":
            start -= 1
        stop = _SPACE.search(text, m.end())
        at = stop.start() if stop else len(text)
        yield from node(start, at)


FEATURES = 30


def features(node: Node) -> np.ndarray:
    """Shape and context of a token, as 0 and 1."""
    _, _, token, before = node
    d, f = _digits(token), np.zeros(FEATURES)
    n = len(d)
    parts = token.split(".")
    f[0] = 1
    f[1] = "@" in token
    f[2] = token[0] == "+"
    f[3:12] = [n == 0, n in (1, 2), n == 3, n == 4, 5 <= n <= 6, 7 <= n <= 9, 10 <= n <= 15, 16 <= n <= 19, n > 19]
    f[12] = len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts)
    f[13] = len(parts) > 1 and not f[12]
    f[14] = "-" in token
    f[15] = "(" in token or ")" in token
    f[16] = n == len(token)
    f[17] = any(c.isalpha() for c in token)
    f[18] = 13 <= n <= 19 and luhn(d)
    f[19] = any(c in token for c in "/:$€%#=_")
    f[20] = bool(re.fullmatch(r"(\d{3}[-.]){1,2}\d{4}", token[:16]))
    f[21] = "@" in token and bool(_DOMAIN.search(token[:300]))
    cues = {w.strip(_EDGE) for w in before.split()[-3:]}
    for i, k in enumerate(KINDS):
        f[22 + i] = bool(cues & CUES[k])
    f[26] = n in (4,) and len(token) == 4 and token[:2] in ("19", "20")
    f[27] = bool(re.fullmatch(r"\d{1,4}-\d{1,2}-\d{1,4}", token[:16]))
    return f


def _sentences(seed: int, count: int) -> Iterator[list[tuple[str, int]]]:
    """Generated tokens with labels: 0 for none, else 1 and on for KINDS."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card() -> str:
        d = r.choice("3456") + num(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def entity(k: int) -> list[str]:
        if k == 1:
            return [f"{word()}{r.choice(['.', '_', ''])}{num(r.randint(0, 2))}@{word()}.{r.choice(['com', 'org', 'example.net'])}"]
        if k == 2:
            return [".".join(str(r.randint(0, 255)) for _ in range(4))]
        if k == 3:
            c = card()
            return r.choice([[c], [c[i : i + 4] for i in range(0, 16, 4)], ["-".join(c[i : i + 4] for i in range(0, 16, 4))]])
        a, b, c = num(3), num(3), num(4)
        return r.choice([[f"+1 ({a})".split()[0], f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"+{num(2)}{num(9)}"]])

    def plain() -> str:
        return r.choice([num(1), num(2), num(3), num(4), f"20{num(2)}", f"{num(1)}.{num(2)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}",
                         f"${num(3)}", f"v{num(1)}.{num(1)}.{num(1)}", f"{word()}{num(3)}", num(6), num(8), num(11), num(16), f"#{num(5)}", f"{num(2)}%"])

    for _ in range(count):
        out: list[tuple[str, int]] = []
        seen: list[tuple[list[str], int]] = []
        for _ in range(r.randint(4, 12)):
            out += [(word(), -1)] * r.randint(0, 4)
            if r.random() < 0.45:
                out.append((plain(), 0))
                continue
            if seen and r.random() < 0.4:
                tokens, k = r.choice(seen)
            else:
                k = r.randint(1, 4)
                tokens = entity(k)
                seen.append((tokens, k))
                if r.random() < 0.5:
                    out.append((r.choice(sorted(CUES[KINDS[k - 1]])), -1))
            out += [(t, k) for t in tokens]
        yield out


@functools.cache
def weights(seed: int = 7, count: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """(node weights, edge potentials by type), fitted on generated sentences.

    Node weights: softmax regression. Edges: log ratio of how often two labels meet to how often they would by chance.
    """
    xs, ys = [], []
    labels = len(KINDS) + 1
    edges = np.full((2, labels, labels), 0.5)
    for sentence in _sentences(seed, count):
        text = " ".join(t for t, _ in sentence)
        at, last, keys = 0, None, {}
        for place, (t, y) in enumerate(sentence):
            if y >= 0:
                core = t.strip(_EDGE)
                xs.append(features((at, at + len(t), core, text[max(0, at - 40) : at].lower())))
                ys.append(y)
                if last and place - last[0] == 1:
                    edges[CHAIN, last[1], y] += 1
                last = (place, y)
                for k in _links(core):
                    if k in keys:
                        edges[SKIP, keys[k], y] += 1
                    keys[k] = y
            at += len(t) + 1
    x, y = np.array(xs), np.eye(labels)[ys]
    w = np.zeros((x.shape[1], labels))
    for _ in range(400):
        p = np.exp(x @ w - (x @ w).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w += 2.0 * (x.T @ (y - p) / len(x) - 1e-4 * w)
    share = y.mean(0)
    for t in (CHAIN, SKIP):
        edges[t] = edges[t] + edges[t].T if t == SKIP else edges[t]
        joint = edges[t] / edges[t].sum()
        edges[t] = np.clip(np.log(joint / np.outer(share, share)), -3, 3)
    return w, edges


def _links(token: str) -> list[str]:
    """Keys under which a token is the same as, or similar to, another."""
    key, d = _key(token.split("@")[0] if "@" in token else token), _digits(token)
    return ([key] if len(key) >= 4 else []) + ([f"~{d[-7:]}"] if len(d) >= 7 and d != key else [f"~{key[-7:]}"] if len(d) >= 7 else [])


def marginals(phi: np.ndarray, src: np.ndarray, dst: np.ndarray, kind: np.ndarray, potentials: np.ndarray,
              rounds: int = 15, damping: float = 0.5, still: float = 1e-3) -> np.ndarray:
    """Label probabilities of each node, by damped loopy sum-product; over once no message moves by ``still``.

    Edges of one kind share a table of potentials, so that a round is a small product for each kind and direction, done for
    ``STRETCH`` edges at once. All messages of a round are made from those of the round before.
    """
    n, labels = phi.shape
    if len(src):
        order = np.argsort(kind, kind="stable")
        src, dst, kind = src[order], dst[order], kind[order]
        cuts = np.searchsorted(kind, np.arange(len(potentials) + 1))
        parts = [(np.exp(t), slice(i, min(i + STRETCH, cuts[k + 1]))) for k, t in enumerate(potentials) for i in range(cuts[k], cuts[k + 1], STRETCH)]
        forth, back = np.zeros((len(src), labels)), np.zeros((len(src), labels))

        def beliefs() -> np.ndarray:
            return phi + np.stack([np.bincount(dst, forth[:, y], n) + np.bincount(src, back[:, y], n) for y in range(labels)], 1)

        def step(pre: np.ndarray, table: np.ndarray, message: np.ndarray) -> np.ndarray:
            pre -= pre.max(axis=1, keepdims=True)
            pre = np.log(np.exp(pre, out=pre) @ table)
            pre -= pre.max(axis=1, keepdims=True)
            pre -= message
            return pre

        for _ in range(rounds):
            held, moved = beliefs(), 0.0
            for table, at in parts:
                there = step(held[src[at]] - back[at], table, forth[at])
                here = step(held[dst[at]] - forth[at], table.T, back[at])
                moved = max(moved, np.abs(there).max(), np.abs(here).max())
                forth[at] += (1 - damping) * there
                back[at] += (1 - damping) * here
            if moved < still:
                break
        phi = beliefs()
    p = np.exp(phi - phi.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _holds(kind: str, span: str, before: str, local: set[str]) -> bool:
    """Whether a span has what its kind needs whatever its probability.

    An e-mail has an at sign or repeats the local part of an address found; a card has 13 to 19 digits that pass the
    checksum, or stands after a word for a card; an address four numbers up to 255; a phone 7 to 15 digits.
    """
    d = _digits(span)
    if kind == "email":
        return "@" in span or _key(span) in local
    if kind == "ip":
        parts = span.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts)
    if kind == "card":
        cues = {w.strip(_EDGE) for w in before.split()[-3:]}
        return 13 <= len(d) <= 19 and (luhn(d) or bool(cues & CUES["card"]))
    return 7 <= len(d) <= 15


#: Up to how many candidate tokens texts are taken together, and of how many edges messages, of how many tokens features are
#: made at once. Results depend on none of them: a text's tokens are in one graph, whatever their number.
SLICE, STRETCH, OVERLAP = 20_000, 100_000, 10_000
_CARD_CUE = 22 + KINDS.index("card")


class _Field:
    """The graph of some texts' tokens, in a few numbers a token."""

    def __init__(self, model: tuple, sure: float):
        self.weights, self.potentials = model
        self.sure = sure
        self.starts, self.ends, self.held = array("q"), array("q"), array("b")
        self.fresh: list[Node] = []
        self.phi: list[np.ndarray] = []
        #: the words before a token, where one is for a card
        self.cues: dict[int, str] = {}
        self.chained = array("q")
        self.link_of, self.links = array("q"), array("Q")
        self.texts, self.begins = 0, True

    def __len__(self) -> int:
        return len(self.starts)

    def start(self) -> None:
        """A new text begins: nothing links to what came before."""
        self.texts += 1
        self.begins = True

    def add(self, node: Node, held: int) -> None:
        i = len(self.starts)
        if not self.begins and node[0] - self.ends[-1] <= 3:
            self.chained.append(i)
        self.begins = False
        self.starts.append(node[0]), self.ends.append(node[1]), self.held.append(held)
        for k in _links(node[2]):
            self.link_of.append(i), self.links.append(xxhash.xxh64_intdigest(k, self.texts))
        self.fresh.append(node)
        if len(self.fresh) >= OVERLAP:
            self._read()

    def _read(self) -> None:
        seen, base = np.stack([features(x) for x in self.fresh]), len(self.starts) - len(self.fresh)
        self.phi.append(seen @ self.weights)
        self.cues |= {base + int(j): self.fresh[j][3] for j in np.flatnonzero(seen[:, _CARD_CUE])}
        self.fresh = []

    def labels(self) -> np.ndarray:
        """Of each node the kind it surely has, from 1; 0 for none, or where a pattern's match holds it."""
        if not self.starts:
            return np.zeros(0, np.int64)
        if self.fresh:
            self._read()
        phi, self.phi = np.concatenate(self.phi), []
        held = np.array(self.held, np.int64)
        phi[np.flatnonzero(held), held[held > 0]] += 12
        chained = np.array(self.chained, np.int64)
        # a token links to the one before it that shares a key
        key, of = np.array(self.links, np.uint64), np.array(self.link_of, np.int64)
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order][1:] == key[order][:-1])
        src, dst = of[order][again], of[order][again + 1]
        order = np.lexsort((src, dst))
        kind = np.repeat([CHAIN, SKIP], [len(chained), len(dst)])
        src, dst = np.concatenate([chained - 1, src[order]]), np.concatenate([chained, dst[order]])
        # all rounds: where they ended would depend on the texts taken together
        p = marginals(phi, src, dst, kind, self.potentials, still=0.0)
        return np.where((p.max(1) >= self.sure) & (held == 0), p.argmax(1), 0)


def _added(text: str, field: _Field, label: np.ndarray, a: int, b: int, local: set[str]) -> list[Span]:
    """Spans of runs of neighbouring tokens of one kind, of the field's tokens from a to b."""
    out, i = [], a
    while i < b:
        start, end = field.starts[i], field.ends[i]
        j = i + 1
        if label[i]:
            while j < b and label[j] == label[i] and field.starts[j] - end <= 3:
                end = field.ends[j]
                j += 1
            kind = KINDS[label[i] - 1]
            if _holds(kind, text[start:end], field.cues.get(i, ""), local):
                out.append((kind, start, end))
        i = j
    return out


def _candidates(text: str, base: list[Span], local: set[str]) -> Iterator[tuple[Node, int]]:
    """Tokens with the kind, from 1, of the pattern's match they lie in; 0 for none."""
    spans, s = sorted((a, b, k) for k, a, b in base), 0
    for node in nodes_of(text, local):
        while s < len(spans) and spans[s][1] <= node[0]:
            s += 1
        yield node, KINDS.index(spans[s][2]) + 1 if s < len(spans) and spans[s][0] < node[1] else 0


def spans_of(texts: Iterable[str | None], sure: float = 0.9, model: tuple | None = None) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text; messages pass within a text only, over all of it.

    Texts meet in one graph up to ``SLICE`` tokens; a text of more has one of its own. A token costs a few hundred bytes.
    """
    model = model or weights()
    field, waiting = _Field(model, sure), []

    def flush() -> Iterator[tuple[list[Span], list[Span]]]:
        label = field.labels()
        for text, base, local, a, b in waiting:
            yield base, _added(text, field, label, a, b, local)

    for text in texts:
        base, local = base_spans(text), set()
        a = len(field)
        if text and _MARK.search(text):
            local = local_parts(text, base)
            field.start()
            for node, k in _candidates(text, base, local):
                field.add(node, k)
        waiting.append((text, base, local, a, len(field)))
        if len(field) >= SLICE or len(waiting) >= 1024:
            yield from flush()
            field, waiting = _Field(model, sure), []
    yield from flush()


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


def _texts(column: pa.Array, rows: int = 64) -> Iterator[str | None]:
    for a in range(0, len(column), rows):
        yield from column.slice(a, rows).to_pylist()


def detect(docs: DataFrame, sure: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row for each row of ``docs``.

    ``found`` lists (kind, start, end, added), in code points, end exclusive; the counts and the digest are of base
    spans. Null and empty texts have none. Repeated rows are read each. An empty table gives no rows.
    """
    df = keyed_texts(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))
    model = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(spans_of(_texts(b.column("text")), sure, model))
            found = [[{"kind": k, "start": s, "end": e, "added": i == 1} for i in (0, 1) for k, s, e in x[i]] for x in got]
            cols = [b.column("doc_id"), pa.array(found, span)]
            cols += [pa.array([sum(s[0] == k for s in x) for x, _ in got], pa.int64()) for k in KINDS]
            cols.append(pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x, _ in got], pa.string()))
            cols.append(pa.array([joined(x + y) for x, y in got], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "found", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return df.mapInArrow(
        run,
        f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint,added:boolean>>, "
        + "".join(f"n_{k} bigint, " for k in KINDS) + "base_sha256 string, spans string",
    )


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, sure: float = 0.9, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked in ``text_col``; all other columns as they are. Nulls stay null."""
    model, name, schema = weights(), text_col, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(name)
            kind = b.column(at).type
            both = zip(_texts(b.column(at)), spans_of(_texts(b.column(at)), sure, model))
            new = [masked(t, x + y) for t, (x, y) in both]
            yield b.set_column(at, b.schema.field(at), pa.array(new, kind))

    return docs.mapInArrow(run, schema)
