"""Secret scans: plain patterns, then structural confirmation of what base64 or hex candidates decode to.

The patterns' matches are always reported. Candidates that decode to a key or a signed token are added: ``pem`` (a
block whose body, after header lines, decodes to DER or an OpenSSH key, or is encrypted in whole blocks), ``der`` (base64
or hex of one ASN.1 SEQUENCE whose nested lengths add up and which begins like a key), ``ssh`` (length-prefixed key
fields) and ``jwt`` (header, payload and signature parts with a JSON header that names an algorithm). Runs of any length
are decoded, if their first letters can begin one of these structures.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_texts

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "ssh", "jwt")
Span = tuple[str, int, int]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Runs that can begin a structure: DER opens with 0x30, SSH fields with a length under 2^24, OpenSSH files with their
#: magic. In base64 that is M and one of A to P, or AAAA, or the magic's letters; in hex their digits.
_MAGIC = b"openssh-key-v1\0"
_OPENING = re.compile(r"(?:M[A-P]|AAAA|b3BlbnNzaC1rZXktdjE|30|00|6f70|6F70)[A-Za-z0-9+/_-]*={0,2}")
_IN_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_FENCE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]+)-----")
_HEADER = re.compile(r"\s*([A-Za-z0-9-]+):(.*)", re.S)
#: Three parts, of which the first decodes to a brace or to white space before one.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([eICD][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
#: Block sizes, in bytes, of the ciphers that encrypted PEM bodies name.
_BLOCKS = {"DES": 8, "AES": 16, "CAMELLIA": 16, "SEED": 16, "IDEA": 8, "BF": 8, "CAST5": 8, "RC2": 8}


def base_spans(text: str, raw: bytes) -> list[Span]:
    """Matches of the plain patterns; ``raw`` is the text in UTF-8, for tests that are cheap on bytes."""
    out: list[Span] = []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out


def decodings(run: str) -> Iterator[bytes]:
    """Bytes of a base64 (either alphabet, padding optional) and of a hex candidate, as far as it is either."""
    body = run.rstrip("=")
    if len(body) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", body):
        yield bytes.fromhex(body)
    if len(body) % 4 != 1 and re.fullmatch(r"[A-Za-z0-9+/_-]+", body):
        yield base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of consecutive DER values that fill ``data`` exactly, checked in constructed ones too."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
            if size < 0x80 or (n > 1 and size < 1 << (8 * (n - 1))):
                return None
        # number 0 is reserved in the universal class alone; [0] is an ordinary context tag
        if at + size > len(data) or not tag & 0xDF:
            return None
        content = data[at : at + size]
        if tag & 0x20 and (depth > 8 or der_items(content, depth + 1) is None):
            return None
        out.append((tag, content))
        at += size
    return out


def is_key_der(data: bytes) -> bool:
    """One SEQUENCE that opens with a small version number or an algorithm's identifier, with another value after."""
    if data[:1] != b"\x30" or (top := der_items(data)) is None or len(top) != 1:
        return False
    inner = der_items(top[0][1])
    if not inner or len(inner) < 2:
        return False
    tag, content = inner[0]
    version = tag == 0x02 and len(content) == 1 and content[0] <= 3
    algorithm = tag == 0x30 and (part := der_items(content)) is not None and bool(part) and part[0][0] == 0x06
    return version or algorithm


def ssh_fields(data: bytes, at: int = 0, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from ``at`` on, up to ``most`` of them or the end, and where they stop; None if a length
    goes beyond the data."""
    fields: list[bytes] = []
    while at < len(data) and len(fields) != most:
        if at + 4 > len(data):
            return None
        (size,) = struct.unpack_from(">I", data, at)
        at += 4
        if at + size > len(data):
            return None
        fields.append(data[at : at + size])
        at += size
    return fields, at


def is_ssh_public(data: bytes) -> bool:
    """Fields that fill the data, the first of them a key type's name."""
    got = ssh_fields(data)
    return got is not None and len(got[0]) > 1 and bool(re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", got[0][0]))


def is_openssh(data: bytes) -> bool:
    """The magic, names of cipher and key derivation and its options, a number of public keys, and one private block;
    all lengths add up, and every public key is one."""
    if not data.startswith(_MAGIC) or (got := ssh_fields(data, len(_MAGIC), 3)) is None:
        return False
    (cipher, kdf, _), at = got if len(got[0]) == 3 else ([b"", b"", b""], 0)
    if not all(re.fullmatch(rb"[A-Za-z0-9@.-]+", x) for x in (cipher, kdf)) or at + 4 > len(data):
        return False
    (keys,) = struct.unpack_from(">I", data, at)
    rest = ssh_fields(data, at + 4)
    if rest is None or keys < 1 or len(rest[0]) != keys + 1:
        return False
    return bool(rest[0][-1]) and all(map(is_ssh_public, rest[0][:-1]))


def is_ssh_key(data: bytes) -> bool:
    return is_openssh(data) if data.startswith(_MAGIC) else is_ssh_public(data)


def is_pem_body(body: str) -> bool:
    """Header lines, if any, then base64 of a key; an encrypted body is confirmed by its headers (cipher and start
    value of its block's size) and by whole blocks."""
    headers: dict[str, str] = {}
    lines = iter(body.split("\n"))
    line = ""
    for line in lines:
        if m := _HEADER.fullmatch(line):
            headers[m[1].lower()] = m[2].strip()
        elif line.strip():
            break
    else:
        return False
    for data in decodings(re.sub(r"\s", "", "".join([line, *lines]))):
        if is_key_der(data) or is_ssh_key(data):
            return True
        if "ENCRYPTED" in headers.get("proc-type", "").upper() and data:
            cipher, _, start = headers.get("dek-info", "").partition(",")
            block = _BLOCKS.get(cipher.strip().upper().split("-")[0])
            if block and len(data) % block == 0 and re.fullmatch(r"[0-9A-Fa-f]{%d}" % (2 * block), start.strip()):
                return True
    return False


def _json_part(part: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):  # bad base64 and bad JSON are both ValueErrors
        return None


def confirmed_spans(text: str, raw: bytes) -> list[Span]:
    """Candidates whose structure confirms a key or a signed token."""
    out: list[Span] = []
    if b"-----BEGIN" in raw:
        begin = None
        for m in _FENCE.finditer(text):  # a block has no other fence inside
            if begin and m[1] == "END" and m[2] == begin[2] and is_pem_body(text[begin.end() : m.start()]):
                out.append(("pem", begin.start(), m.end()))
            begin = m if m[1] == "BEGIN" else None
    if raw.count(b".") > 1:
        for m in _TOKEN.finditer(text):
            head = _json_part(m[1])
            if isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(_json_part(m[2]), dict):
                out.append(("jwt", m.start(), m.end()))
    blocks = [s for s in out if s[0] == "pem"]
    for m in _OPENING.finditer(text):
        if m.start() and text[m.start() - 1] in _IN_RUN:
            continue  # the rest of a run
        while blocks and blocks[0][2] <= m.start():
            blocks.pop(0)
        if blocks and blocks[0][1] < m.start():
            continue  # told as a block already
        for data in decodings(m[0]):
            if is_key_der(data) or is_ssh_key(data):
                out.append(("der" if data[:1] == b"\x30" else "ssh", m.start(), m.end()))
                break
    return out


def spans(text: str | None) -> list[Span]:
    """All spans of a text, by start, then kind."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    out = base_spans(text, raw)
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    out += confirmed_spans(text, raw)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found, n_assign, n_access, n_hex, base_sha256, spans): one row for each row of ``docs``.

    ``found`` lists (kind, start, end), in code points, end exclusive. Null and empty texts have none. Repeated rows are
    scanned each. An empty table gives no rows.
    """
    df = keyed_texts(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    struct_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [spans(t.as_py()) for t in b.column("text")]
            base = [[s for s in x if s[0] in BASE_KINDS] for x in every]
            cols = [b.column("doc_id"), pa.array([[{"kind": k, "start": a, "end": e} for k, a, e in x] for x in every], struct_type)]
            cols += [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in BASE_KINDS]
            cols.append(pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()))
            cols.append(pa.array([joined(x) for x in every], pa.string()))
            names = ["doc_id", "found", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(
        run,
        f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>, n_assign bigint, n_access bigint, "
        "n_hex bigint, base_sha256 string, spans string",
    )
