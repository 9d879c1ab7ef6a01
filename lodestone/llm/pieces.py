"""SentencePiece encoding with source offsets, and decoding.

Encoding normalises each text by longest-prefix matches through the model's compiled
character map (a double-array trie) and records, for each normalised byte, the source
byte it came from. The normalised text is cut where a space mark follows another
character; no piece of a whitespace-splitting BPE model spans such a place, so a Python
worker has the library segment each distinct cut once, and every piece is projected to
its byte span in the original text through the recorded alignment.

Defined cases: a null or empty text has no pieces (with an end id: that id alone) and
decodes to the empty text; rows are independent, so repeated rows and extra columns
need nothing; texts of any length are whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import cluster

MARK = "▁"
_CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")
_CACHE = 1_000_000  # cuts kept in a Python worker, about 200 MB


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class CharMap:
    """The compiled character map: a Darts double-array trie over a pool of replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.pool = b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{n // 4}I", blob, 4))
            self.pool = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and source length of the longest prefix of data[at:] in the map."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start, size = found
        return self.pool[start : self.pool.index(b"\0", start)], size


class _Cuts(dict):
    """Packed ids of the cuts, without their first mark; a missing one is segmented, and kept while there is room."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, cut: str) -> bytes:
        ids = self.model.cut_ids(cut)
        if len(self) < _CACHE:
            self[cut] = ids
        return ids


class Model:
    """What encoding and decoding need of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dummy, self.squeeze, self.escape, charsmap = True, True, True, b""
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 3:  # normalizer_spec
                    for k, v in _fields(value):
                        if k == 2:
                            charsmap = v
                        elif k == 3:
                            self.dummy = bool(v)
                        elif k == 4:
                            self.squeeze = bool(v)
                        elif k == 5:
                            self.escape = bool(v)
        self.map = CharMap(charsmap)
        n = self.library.get_piece_size()
        text = [self.library.id_to_piece(i) for i in range(n)]
        control = [self.library.is_control(i) for i in range(n)]
        byte = [self.library.is_byte(i) for i in range(n)]
        self.size = np.array([0 if c else 1 if b else len(t.encode()) for t, c, b in zip(text, control, byte)], np.int64)
        unknown = self.library.unk_id()
        if unknown >= 0:
            self.size[unknown] = -1
        inner = any(MARK in t.lstrip(MARK) for t in text)
        self.cuttable = self.escape and not inner and not self.library.is_unknown(self.library.piece_to_id(MARK))
        self.known = _Cuts(self)
        self.odd: dict[str, bytes] = {}  # cuts that don't decode to their own text

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, the source byte offset; of an empty text, nothing and its end."""
        source = text.encode()
        space = MARK.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze:
            if not source:
                return b"", np.zeros(1, np.int64)
            raw = np.frombuffer(source, np.uint8)
            width = np.where(raw == 32, len(space), 1)
            at = np.repeat(np.arange(len(raw)), width)
            head = np.zeros(len(space) if self.dummy else 0, np.int64)
            out = source.replace(b" ", space)
            return (space if self.dummy else b"") + out, np.concatenate([head, at, [len(raw)]])
        steps: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(source):
            hit = self.map.longest(source, at) if self.map.units else None
            if hit is None:
                b = source[at]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                hit = (source[at : at + n], n)
            steps.append((hit[0], at, at + hit[1]))
            at += hit[1]
        if self.squeeze:
            while steps and steps[0][0] == b" ":
                steps.pop(0)
        out, back, blank = bytearray(), [], self.squeeze
        if steps and self.dummy:
            out += space
            back += [steps[0][1]] * len(space)
        end = steps[0][1] if steps else 0
        for piece, lo, hi in steps:
            if blank and self.squeeze:
                piece = piece.lstrip(b" ")
            for b in piece:
                x = space if b == 32 else bytes([b])
                out += x
                back += [lo] * len(x)
            if piece:
                blank, end = piece.endswith(b" "), hi
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = back[len(out)]
                del back[len(out) :]
        return bytes(out), np.array([*back, end], np.int64)

    def cut_ids(self, cut: str) -> bytes:
        """Packed ids of a mark and what follows it up to the next place to cut."""
        if not cut:  # the library drops a lone mark as an empty text
            return np.array([self.library.piece_to_id(MARK)], "<i4").tobytes()
        ids = self.library.encode(cut)
        back = self.library.decode(ids)
        if back != cut.replace(MARK, " "):
            self.odd[cut] = back.encode()
        return np.array(ids, "<i4").tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, bytes]]:
        """Packed 32-bit ids, source spans (n, 2) and decoded bytes of each text."""
        whole = self.map.units or self.squeeze or not self.dummy or not self.cuttable
        get = self.known.__getitem__
        for t in texts:
            if not t:
                yield b"", np.zeros((0, 2), np.int64), b""
                continue
            n, back = self.normalise(t)
            if whole:
                ids = self.library.encode(t)
                packed, plain = np.array(ids, "<i4").tobytes(), self.library.decode(ids).encode()
            else:
                x = n.decode()
                cuts = [c[1:] for c in _CUT.split(x)] if MARK + MARK in x else x.split(MARK)[1:]
                packed = b"".join(map(get, cuts))
                if self.odd and not self.odd.keys().isdisjoint(cuts):
                    plain = b"".join([b" " + self.odd.get(c, c.replace(MARK, " ").encode()) for c in cuts])[1:]
                else:
                    plain = n.replace(MARK.encode(), b" ")[1:]
            ids = np.frombuffer(packed, "<i4")
            size = self.size[ids]
            if size.min(initial=0) < 0:
                size = self._unknown(n, ids, size)
            stop = np.cumsum(size)
            yield packed, np.stack([back[stop - size], back[stop]], 1), plain

    def _unknown(self, n: bytes, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sizes where the unknown id stands for a run of characters: up to the next piece's text."""
        size, at = size.copy(), 0
        for i, k in enumerate(ids):
            if size[i] < 0:
                rest = next((self.library.id_to_piece(int(j)).encode() for j in ids[i + 1 :] if self.size[j] > 0), None)
                stop = n.find(rest, at + 1) if rest else len(n)
                size[i] = (stop if stop >= 0 else len(n)) - at
            at += int(size[i])
        return size


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def _encoded(it: Iterator[pa.RecordBatch], model_path: str, add_end: bool) -> Iterator[tuple[pa.Array, list[tuple[bytes, np.ndarray, bytes]]]]:
    """Document ids and encodings of batches of (doc_id, text)."""
    m = model(model_path)
    end = np.array([m.library.eos_id()], "<i4").tobytes() if add_end else b""
    for batch in cluster.batches(it, 200):
        texts = batch.column(1).to_pylist()
        out = []
        for t, (packed, span, plain) in zip(texts, m.encode(texts)):
            if add_end:
                n = len(t.encode()) if t else 0
                span = np.concatenate([span, [[n, n]]])
            out.append((packed + end, span, plain))
        yield batch.column(0), out


def encode(docs: DataFrame, model_path: str, add_end: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids, spans, decoded) of each whole text.

    ids: packed little-endian 32-bit; spans: packed 32-bit begin and end bytes in the
    source text of each piece (the end id has the empty span at the end); decoded: the
    UTF-8 text that decoding the ids gives.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _encoded(it, model_path, add_end):
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1].astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "ids", "spans", "decoded"])

    return cluster.texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids binary, spans binary, decoded binary")


def digests(docs: DataFrame, model_path: str, add_end: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, span_end) of what encode() gives, in one pass."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        names = [str(i) for i in range(model(model_path).library.get_piece_size())]
        for ids, rows in _encoded(it, model_path, add_end):
            listed = [sha256(" ".join([names[i] for i in np.frombuffer(r[0], "<i4").tolist()]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(r[0]) // 4 for r in rows], pa.int64()), pa.array(listed, pa.string()), pa.array([sha256(r[2]).hexdigest() for r in rows], pa.string()), pa.array([int(r[1][-1, 1]) if len(r[1]) else 0 for r in rows], pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_end"],
            )

    return cluster.texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_end long")
