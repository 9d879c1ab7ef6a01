"""Secret scanning with structural confirmation.

Three base patterns find assignments, access ids and long hexadecimal runs. Beside
them, every base64 or hexadecimal candidate is decoded and parsed before it is
reported: DER key encodings must have nested lengths that fill their parents exactly
(RSA, EC, PKCS#8, SubjectPublicKeyInfo), OpenSSH keys length-prefixed fields, signed
tokens a header that is a JSON object with an algorithm (the payload may be any). Keys
are also found inside longer runs, by the length that their first bytes declare, and
wrapped over lines. What does not parse is not reported.

Defined cases: a null or empty text has no spans; rows are independent, so repeated
rows and extra columns need nothing; texts of any length are scanned whole. Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster

#: In the order in which spans that start at one place are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: No character of the alphabets of the runs beside it; a run of the least length then holds no failing match.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)

#: The part before the payload; what follows is looked at alone, as it may be the header itself.
_HEAD = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}+(?=\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*+))")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*(?:PRIVATE KEY|PUBLIC KEY|CERTIFICATE))-----((?:[A-Za-z0-9+/=\s]++|\\++[nr])++)-----END \1-----")
#: An opening brace with the white space before it, in decoded bytes.
_OBJECT = re.compile(rb"[ \t\r\n]*+\{")
_BREAK = re.compile(r"\\+[nr]|\s+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
#: Lines of base64 that belong together.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,76}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/]+={0,2}")
#: The six bits of each character of base64 in either alphabet.
_SEXTET = np.zeros(256, np.uint8)
for _alphabet in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"):
    _SEXTET[list(_alphabet)] = range(64)
_JSON = json.JSONDecoder()
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{64,}")

# Encoded object identifiers of key algorithms.
_OIDS = {
    "2a864886f70d010101": "rsa",
    "2a864886f70d01010a": "rsa-pss",
    "2a8648ce3d0201": "ec",
    "2a8648ce380401": "dsa",
    "2b656e": "x25519",
    "2b6570": "ed25519",
    "2b6571": "ed448",
}


def _b64(text: str) -> bytes | None:
    raw = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(raw) % 4 == 1:
        return None
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except binascii.Error:
        return None


#: Values that one level of a key holds at most (a private RSA key has 9, a certificate's first part 10), and bytes of a modulus.
_ITEMS, _MODULUS = 16, 1 << 16


def der_items(data: bytes, lo: int, hi: int) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the values that fill data[lo:hi] exactly, or None; no level of a key has more than _ITEMS."""
    out = []
    while lo < hi:
        if lo + 2 > hi or len(out) == _ITEMS:
            return None
        tag, n, at = data[lo], data[lo + 1], lo + 2
        if n & 128:
            k = n & 127
            if not 1 <= k <= 4 or at + k > hi:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            if n < 128 or (k > 1 and n >> (8 * (k - 1)) == 0):
                return None  # not the shortest form
            at += k
        if at + n > hi:
            return None
        out.append((tag, at, at + n))
        lo = at + n
    return out


def der_key(data: bytes, lo: int = 0, hi: int | None = None) -> str | None:
    """The kind of key that data[lo:hi] encodes, with every nested length checked, or None.

    Nothing is copied before the headers of a level fit, so what isn't a key costs a few of them.
    """
    top = der_items(data, lo, len(data) if hi is None else hi)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return None
    items = der_items(data, *top[0][1:])
    if not items:
        return None
    tags = [t for t, _, _ in items]
    number = lambda i: int.from_bytes(data[items[i][1] : items[i][2]], "big")
    if tags == [2] * 9 and items[1][2] - items[1][1] <= _MODULUS and number(0) == 0:
        return "rsa-private" if number(1) == number(4) * number(5) else None
    if tags == [2, 2] and items[0][2] - items[0][1] >= 64 and number(1) % 2:
        return "rsa-public"
    if tags[:2] == [2, 4] and number(0) == 1 and set(tags[2:]) <= {0xA0, 0xA1} and len(tags) > 2:
        return "ec-private" if all(der_items(data, a, b) for _, a, b in items[2:]) else None

    def algorithm(i: int) -> str | None:
        inner = der_items(data, *items[i][1:])
        if items[i][0] != 0x30 or not inner or inner[0][0] != 6:
            return None
        return _OIDS.get(data[inner[0][1] : inner[0][2]].hex())

    if tags[:3] == [2, 0x30, 4] and number(0) in (0, 1) and (kind := algorithm(1)):
        a, b = items[2][1:]
        inner = der_items(data, a, b)
        return f"{kind}-private" if inner and len(inner) == 1 else None
    if tags == [0x30, 3] and (kind := algorithm(0)) and data[items[1][1] : items[1][1] + 1] == b"\0":
        return f"{kind}-public"
    if tags == [0x30, 0x30, 3] and algorithm(1) is None and der_items(data, *items[0][1:]) and der_items(data, *items[1][1:]):
        return "certificate"
    return None


def ssh_key(data: bytes) -> str | None:
    """Kind of an OpenSSH public or private key whose length-prefixed fields fill it, or None."""
    magic = b"openssh-key-v1\0"
    private = data.startswith(magic)
    at, fields = len(magic) if private else 0, []
    while at + 4 <= len(data) and len(fields) < 64:
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            break
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
        if private and len(fields) == 3:
            return "openssh-private" if fields[0].isascii() and at < len(data) else None
    if at == len(data) and len(fields) >= 2 and re.fullmatch(rb"(ssh-|ecdsa-sha2-|sk-)[a-z0-9@.-]+", fields[0]):
        return fields[0].decode()
    return None


def signed_header(part: str) -> int | None:
    """Where in ``part`` base64 begins that is, to its end, a JSON object naming an algorithm, or None.

    Such text may follow others without a break, so all four ways to cut into quads are decoded.
    """
    found = []
    for skip in range(4):
        data = _b64(part[skip:])
        if not data or not data.rstrip().endswith(b"}"):
            continue
        text = data.decode("latin-1")  # a character a byte; whether it is UTF-8 is asked of what parses
        for m in _OBJECT.finditer(data):
            at = m.start() + -m.start() % 3  # characters go with bytes by quads
            if at > m.end() - 1:
                continue
            try:
                h, end = _JSON.raw_decode(text, m.end() - 1)
                if text[end:].strip(" \t\r\n"):
                    continue
                data[at:].decode()
            except (ValueError, RecursionError):
                continue
            if isinstance(h, dict) and isinstance(h.get("alg"), str) and h["alg"].isascii():
                found.append(skip + at // 3 * 4)
                break
    return min(found, default=None)


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of tokens whose header names an algorithm; any base64 may be the payload."""
    out, last = [], 0
    for m in _HEAD.finditer(text):
        if m.start() >= last and _b64(m[1]) is not None and (at := signed_header(m[0])) is not None:
            last = m.end(2)
            out.append((m.start() + at, last))
    return out


def key_beginnings(run: str) -> Iterator[tuple[int, int]]:
    """(place, bytes) of DER sequences in a run of base64 that declare a length which is there, and whose first value fits into it."""
    raw = np.frombuffer(run.encode("ascii"), np.uint8)
    # 'M' and one of 'A' to 'P': the byte of a sequence, wherever its quads begin.
    at = np.flatnonzero((raw[:-1] == 77) & (raw[1:] >= 65) & (raw[1:] <= 80))
    at = at[len(run) - at >= 40]
    if not len(at):
        return
    six = _SEXTET[raw]
    head = [(six[at + i * 8 // 6].astype(np.int64) << 6 | six[at + i * 8 // 6 + 1]) >> (4 - i * 8 % 6) & 255 for i in range(1, 13)]

    def declared(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a header whose length is at head[i] and of what follows it; a length of more than four bytes counts as too long."""
        first = np.choose(i, head[:7])
        more = np.where(first >= 128, first & 127, 0)
        size = np.where(first < 128, first, 0)
        for j in range(1, 5):
            size = np.where(j <= more, size << 8 | np.choose(i + j, head[:11]), size)
        return 2 + more, np.where((more > 4) | (first == 128), 1 << 40, size)

    header, size = declared(np.zeros(len(at), int))
    whole = header + size
    fits = (whole >= 30) & (at + -(-8 * whole // 6) <= len(run)) & (size < 1 << 40)
    at, header, whole, head = at[fits], header[fits], whole[fits], [h[fits] for h in head]
    if len(at):
        inner, size = declared(header)
        tag = np.choose(header - 1, head[:6])
        ok = ((tag == 2) | (tag == 0x30)) & (header + inner + size <= whole)
        yield from zip(at[ok].tolist(), whole[ok].tolist())


def keys_inside(run: str) -> list[tuple[int, int]]:
    """(start, end) of DER keys that begin anywhere in a run of base64, as long as they declare.

    The run is decoded at most once for each of the four ways to cut it into quads;
    candidates are walked in those bytes.
    """
    out, last, decoded = [], 0, {}
    for at, n in key_beginnings(run):
        if at < last:
            continue
        skip = at % 4
        if skip not in decoded:
            rest = run[skip:]
            decoded[skip] = _b64(rest[:-1] if len(rest) % 4 == 1 else rest)
        lo = (at - skip) // 4 * 3
        if der_key(decoded[skip], lo, lo + n):
            last = at + -(-8 * n // 6)
            out.append((at, last))
    return out


class Covered:
    """Whether a place lies in one of some spans, which may overlap."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def __contains__(self, place: int) -> bool:
        i = bisect_right(self.starts, place)
        return i > 0 and place < self.ends[i - 1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The assign, access and hex spans: leftmost, non-overlapping for each kind."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans whose decoded content parses as a key or a signed token."""
    out = []
    if "." in text:
        out += [(a, b, "jwt") for a, b in signed_tokens(text)]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = _b64(_BREAK.sub("", m[2]))
            if data and (der_key(data) or ssh_key(data)):
                out.append((m.start(), m.end(), "pem"))
    inside = Covered((a, b) for a, b, k in out)  # tokens and PEM blocks so far
    runs = [m for m in _BASE64.finditer(text) if m.start() not in inside]
    wrapped = []
    if any(text[m.end() : m.end() + 1].isspace() for m in runs):
        for m in _WRAPPED.finditer(text):
            if m.start() in inside:
                continue
            data = _b64("".join(m[0].split()))
            if data and (kind := "der" if der_key(data) else "ssh" if ssh_key(data) else None):
                wrapped.append((m.start(), m.end(), kind))
    out += wrapped
    inside = Covered((a, b) for a, b, _ in out)
    found = []
    for m in runs:
        if m.start() in inside:
            continue
        data = _b64(m[0])
        if data and data[0] == 0x30 and der_key(data):
            found.append((m.start(), m.end(), "der"))
        elif data and (data[:3] == b"\0\0\0" or data[:15] == b"openssh-key-v1\0") and ssh_key(data):
            found.append((m.start(), m.end(), "ssh"))
        else:
            for a, b in keys_inside(m[0].rstrip("=")):
                b += len(m[0]) - len(m[0].rstrip("=")) if b == len(m[0].rstrip("=")) else 0
                found.append((m.start() + a, m.start() + b, "der"))
    for m in _ANY_HEX.finditer(text):
        if m.start() in inside:
            continue
        data = bytes.fromhex(m[0][: len(m[0]) // 2 * 2])
        if data[0] == 0x30 and der_key(data):
            found.append((m.start(), m.end(), "der"))
        elif (data[:3] == b"\0\0\0" or data[:15] == b"openssh-key-v1\0") and ssh_key(data):
            found.append((m.start(), m.end(), "ssh"))
    return out + found


def find(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text: (start, end, kind) by start, then kind as listed in KINDS."""
    if not text:
        return []
    return sorted({*base_spans(text), *confirmed_spans(text)}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "array<struct<start: long, end: long, kind: string>>"


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans) of each whole text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in cluster.batches(it, 1000):
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return cluster.texts(docs, id_column, text_column).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redacted(docs: DataFrame, text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with each span, overlapping ones merged, replaced by the mask.

    Columns may be called anything: only the text column, found by its place, is rewritten.
    """
    rows, at = cluster.by_position(docs), docs.columns.index(text_column)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cluster.batches(it, 1000):
            out = []
            for text in batch.column(at).to_pylist():
                parts, last = [], 0
                for a, b, _ in find(text):
                    if a >= last:
                        parts += [text[last:a], mask]
                    last = max(last, b)
                out.append("".join(parts) + text[last:] if last else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
