"""Token-ID files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

A dataset is a folder of part files in ascending document order and their list. Each
part has ``NAME.bin`` (little-endian ids, 2 bytes each where the vocabulary fits, else 4) and
``NAME.idx`` (magic, id width, 64-bit counts, then the 64-bit start of each document
inside the part and one end, then the 64-bit document ids with a null flag each).
Where a part begins in the whole stream is the prefix sum of the sizes of the parts
before it; only one count a part reaches the driver. How many parts there are follows
from the bytes of text, so a part has a bounded size whatever the table's.

Encoding cuts a text at each space before a non-space character, and pieces of Latin
letters as the byte-level pre-tokenizer does. It never joins across such a place, so a
Python worker has the library encode each distinct part once and the ids of a text are
those of its parts, joined. A tokenizer with another pre-tokenizer encodes whole texts.

Defined cases: a null or empty text has the end id alone; rows without doc_id come
first, in as many parts as their share of the rows asks for; rows with one doc_id follow
each other in an order fixed by their ids and are in one part; an empty table gives an
empty dataset; other columns play no part.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster

MAGIC = b"LDSTOK1\0"
_CUT = re.compile(r" (?=[^\s])")
_ODD = re.compile(r" \s")
_CACHE = 1_000_000  # pieces kept in a Python worker, about 200 MB; for their numbers alone fewer
#: The byte-level pre-tokenizer and its pattern.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LATIN = re.compile("[\x00-\x1b\x20-\x7e\xa1-\u017f]*")  # where both libraries agree on letters, digits and white space
PART_BYTES = 32 << 20  # expected text of a part


class _Parts(dict):
    """What the library says of parts of texts, kept while there is room; ``sparing``, from the second time on, as most come up once."""

    def __init__(self, encoder: Encoder, of, most: int, sparing: bool):
        self.encoder, self.of, self.most = encoder, of, most
        self.seen = bytearray(1 << 22) if sparing else None

    def __missing__(self, part: str):
        return self.keep(part, self.of(self.encoder.ids(part)))

    def keep(self, part: str, out):
        if len(self) < self.most and len(part) < 40:
            at = hash(part) & 0x3FFFFF
            if self.seen is None or self.seen[at]:
                self[part] = out
            else:
                self.seen[at] = 1
        return out


class _Pieces(_Parts):
    """The same of the pieces after a space: of one part, or joined from that and others."""

    def __init__(self, encoder: Encoder, of, join, most: int = _CACHE, sparing: bool = False):
        super().__init__(encoder, of, most, sparing)
        self.join, self.others = join, _Parts(encoder, of, most, sparing)

    def __missing__(self, piece: str):
        if not piece.isalpha() and _LATIN.fullmatch(piece):
            first, *rest = _PART.findall(" " + piece)
            if rest:
                return self.keep(piece, self.join([self[first[1:]], *map(self.others.__getitem__, rest)]))
        return self.keep(piece, self.of(self.encoder.ids(" " + piece)))


class Encoder:
    """Ids of whole texts, as bytes of little-endian integers of ``width`` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [a.content for a in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.by_parts = json.loads(self.library.to_str()).get("pre_tokenizer") == BYTE_LEVEL
        self.known = _Pieces(self, self.pack, b"".join)
        self.sizes = _Pieces(self, len, sum, 6 * _CACHE // 10, True)

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return self.pack(self.ids(text))

    def cut(self, text: str) -> list[str]:
        """What stands before the first cut, and the pieces after each without their space."""
        if not self.by_parts or any(s in text for s in self.special):
            return [text]
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out, get = [], self.known.__getitem__
        for text in texts:
            head, *rest = self.cut(text) if text else [""]
            out.append((self.whole(head) if head else b"") + b"".join(map(get, rest)))
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        """How many ids each text has."""
        out, get = [], self.sizes.__getitem__
        for text in texts:
            head, *rest = self.cut(text) if text else [""]
            out.append((len(self.ids(head)) if head else 0) + sum(map(get, rest)))
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder, with its pieces, for all tasks of a Python worker."""
    return Encoder(path)


@dataclass(frozen=True)
class Parts:
    """How documents are dealt to parts: ``bare`` parts of rows without id, then one a range between the bounds."""

    bare: int
    bounds: tuple[int, ...]

    def __len__(self) -> int:
        return self.bare + len(self.bounds) + 1

    def of(self, doc_ids: pa.Array, ids: list[bytes]) -> np.ndarray:
        null = doc_ids.is_null().to_numpy(zero_copy_only=False)
        out = self.bare + np.searchsorted(np.array(self.bounds, np.int64), doc_ids.fill_null(0).to_numpy())
        for i in np.flatnonzero(null):
            out[i] = zlib.crc32(ids[i]) % max(1, self.bare)
        return out


def plan_parts(docs: DataFrame, parts: int | None = None) -> Parts:
    """Parts of about equal numbers of documents; docs: (doc_id, text). ``parts``: how many, by size where not given."""
    n, bare, size = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, parts or -(-size // PART_BYTES))
    null = min(max(1, parts - 1), -(-parts * bare // n)) if bare else 0
    cuts = [x / max(1, parts - null) for x in range(1, parts - null)]
    ids = docs.select("doc_id").filter("doc_id is not null")
    return Parts(null, tuple(sorted({int(x) for x in ids.approxQuantile("doc_id", cuts, 0.1 / parts)})) if cuts else ())


def encode(docs: DataFrame, tokenizer: str, end_id: int | None = None, parts: Parts | None = None) -> DataFrame:
    """(part, doc_id, ids): the ids of each whole text as packed little-endian integers; docs: (doc_id, text)."""
    parts = parts or Parts(0, ())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = b"" if end_id is None else encoder.pack([end_id])
        for batch in cluster.batches(it, 1000):
            ids = [x + end for x in encoder(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(parts.of(batch.column(0), ids).astype(np.int32)), batch.column(0), pa.array(ids, pa.binary())], ["part", "doc_id", "ids"])

    return docs.mapInArrow(run, "part int, doc_id long, ids binary")


def write(encoded: DataFrame, folder: str, width: int, parts: int) -> DataFrame:
    """Write (part, doc_id, ids) in ascending order; returns (part, name, n_docs, n_tokens, base_token, base_doc).

    A part is written by one task under a name of its own attempt, so what a lost or
    repeated task has written is never read.
    """
    spark = encoded.sparkSession
    seats = cluster.seats(spark, parts)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = cluster.open_folder(folder)
        tag = f"{TaskContext.get().taskAttemptId()}"
        state = None

        def close(state) -> pa.RecordBatch:
            part, out, starts, docs, null = state
            out.close()
            with store.open_output_stream(f"{path}/{part:06d}-{tag}.idx") as f:
                f.write(MAGIC + struct.pack("<qqq", width, len(docs), starts[-1]))
                for x in (starts, docs):
                    f.write(np.frombuffer(x, np.int64).astype("<i8").tobytes())
                f.write(bytes(null))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [f"{part:06d}-{tag}"], "n_docs": [len(docs)], "n_tokens": [starts[-1]]})

        for batch in cluster.batches(it, 1000):
            for p, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if state is None or state[0] != p:
                    if state:
                        yield close(state)
                    store.create_dir(path, recursive=True)
                    state = (p, store.open_output_stream(f"{path}/{p:06d}-{tag}.bin"), array("q", [0]), array("q"), bytearray())
                raw = ids.as_buffer()
                state[1].write(raw)
                state[2].append(state[2][-1] + len(raw) // width)
                state[3].append(d or 0)
                state[4].append(d is None)
        if state:
            yield close(state)

    seat = F.element_at(F.array(*(F.lit(x).cast("long") for x in seats)), F.col("part") + 1) if parts <= 256 else F.col("part")  # one part a task
    dealt = encoded.repartition(parts, seat).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
    rows = sorted(tuple(r) for r in dealt.mapInArrow(run, "part int, name string, n_docs long, n_tokens long").collect())  # one row a part
    out, token, doc = [], 0, 0
    for p, name, d, t in rows:
        out.append((p, name, d, t, token, doc))
        token, doc = token + t, doc + d
    return spark.createDataFrame(out, "part int, name string, n_docs long, n_tokens long, base_token long, base_doc long")


def _mapped(store, path: str) -> np.ndarray:
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if store.get_file_info(path).size else np.zeros(0, np.uint8)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), np.uint8)


def read(parts: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document of a dataset; ids as packed 32-bit integers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = cluster.open_folder(folder)
        for batch in it:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index = _mapped(store, f"{path}/{part}.idx")
                if index[:8].tobytes() != MAGIC:
                    raise ValueError(f"part {part} is not a token file")
                width, n, _ = struct.unpack("<qqq", index[8:32].tobytes())
                starts = np.frombuffer(index[32 : 32 + 8 * (n + 1)].tobytes(), "<i8")
                docs = np.frombuffer(index[32 + 8 * (n + 1) : 32 + 8 * (2 * n + 1)].tobytes(), "<i8")
                null = index[32 + 8 * (2 * n + 1) :].astype(bool)
                ids = _mapped(store, f"{path}/{part}.bin").view("<u2" if width == 2 else "<u4")
                for lo in range(0, n, 500):
                    hi = min(n, lo + 500)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[lo:hi], mask=null[lo:hi]), pa.array(starts[lo:hi] + base), pa.array(np.diff(starts[lo : hi + 1])), pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(starts[lo:hi], starts[lo + 1 : hi + 1])], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    n = max(1, parts.count())
    return parts.repartitionByRange(n, "part").select("name", "base_token").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, folder: str | None = None, parts: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, str]:
    """Encode and write a table of documents; returns the parts, the documents read back and the folder."""
    folder = folder or cluster.scratch(docs.sparkSession, "tokens")
    rows = cluster.texts(docs, id_column, text_column)
    plan = plan_parts(rows, parts)
    written = write(encode(rows, tokenizer, end_id, plan), folder, encoder_of(tokenizer).width, len(plan))
    return written, read(written, folder), folder
