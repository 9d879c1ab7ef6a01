"""ARC to WARC conversion.

An ARC file is a version block, its first record, followed by URL records; version 1
header lines have five fields (URL, IP address, date, content type, length), version 2
lines ten (... result code, checksum, location, offset, filename, length). The line the
version block declares tells the fields, the declared length the content: nothing is
guessed from the content itself. The version block becomes a warcinfo record. Each other
record becomes a WARC record whose identifier is a UUID derived from the file, its place
there, address, date and digest, whose date is the ARC date in ISO form and whose digests
are SHA-256 of block and payload. A record that holds an HTTP answer is a response and
its payload what follows the head; others are resources. Repeats of a payload become
revisits, which keep the head and name the record, address and date that they refer to;
a record that others refer to is identified by what they know of it (its page, address,
date and digest) in place of file and offset.

Tables of pages become ARC files of many records, by version, which are converted as a
whole, an HTTP head being put before each payload. Beside the files there is an index of
(path, offset, record, page); reading an archive back goes through it: a record's page by
its identifier, a revisit's page and payload length by the record that it refers to.

Defined cases: a null payload is empty; null urls are written as ``-``; urls may look
like a version block's; payloads under ``least`` bytes are always responses; rows that
share the smallest id and the payload are all responses; pages without id revisit the
smallest id, or are responses where no page of their payload has one; an empty table
gives an archive without files; other columns play no part.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster

# The field names of the two versions' header lines.
ARC1 = ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"]
ARC2 = ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space
_PAGE_SIZE = 4 << 20
DATE = "20240101000000"
_HTTP = "application/http;msgtype=response"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    content: bytes
    version: int = 1


def _line(text: str) -> str:
    return re.sub(r"[\s\x00]", lambda m: f"%{ord(m[0]):02X}", text) or "-"


def arc_version_block(version: int, name: str, date: str) -> bytes:
    names = " ".join(ARC1 if version == 1 else ARC2)
    body = f"{version} 0 lodestone\n{names}\n".encode()
    url = f"filedesc://{name}"
    head = [url, "0.0.0.0", date, "text/plain"] + ([] if version == 1 else ["200", "-", "-", "0", name]) + [str(len(body))]
    return " ".join(head).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, date: str, mime: str, content: bytes, ip: str = "0.0.0.0") -> bytes:
    rest = [] if version == 1 else ["200", sha256(content).hexdigest()[:32], "-", "0", "-"]
    return " ".join([_line(url), ip, date, mime, *rest, str(len(content))]).encode() + b"\n" + content + b"\n"


def read_arc(data: bytes, block: bool = False) -> Iterator[ArcRecord]:
    """Records of an ARC file, with ``block`` the version block first; the fields are those of its own line."""
    at, names, version, first = 0, ARC1, 1, True
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        opens = first and parts[0].startswith("filedesc://")
        if opens:
            names = ARC2 if len(parts) == len(ARC2) else ARC1
        if len(parts) < len(names):
            raise ValueError(f"ARC header line at byte {at} has {len(parts)} fields; version {version} has {len(names)}")
        extra = len(parts) - len(names)  # a URL or type with spaces: the fields count from both ends
        fields = dict(zip(names, ["%20".join(parts[: extra + 1]), *parts[extra + 1 :]]))
        n = int(fields["Archive-length"])
        content = data[end + 1 : end + 1 + n]
        if len(content) < n:
            raise ValueError(f"ARC record at byte {at} is cut off: {len(content)} of {n} bytes")
        at, first = end + 1 + n, False
        if opens:
            lines = content.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0])
            names = lines[1].split(" ")
        if block or not opens:
            yield ArcRecord(fields, content, version)


def http_parts(content: bytes) -> tuple[bytes, bytes] | None:
    """Head, with the blank line that ends it, and body of an HTTP answer, or None."""
    if not content.startswith(b"HTTP/"):
        return None
    ends = [at + len(gap) for gap in (b"\r\n\r\n", b"\n\n") if (at := content.find(gap)) >= 0]
    end = min(ends, default=len(content))
    return content[:end], content[end:]


def with_head(payload: bytes, mime: str = "text/html; charset=utf-8") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""
    payload_digest: str = field(default="")

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head of a response; nothing in a revisit."""
        if self.headers["WARC-Type"] == "revisit":
            return b""
        return http_parts(self.block)[1] if self.headers["Content-Type"] == _HTTP else self.block

    def dump(self) -> bytes:
        lines = "".join(f"{k}: {v}\r\n" for k, v in self.headers.items())
        return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + self.block + b"\r\n\r\n"


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def iso_date(arc: str) -> str:
    d = arc.ljust(14, "0")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warcinfo(r: ArcRecord) -> WarcRecord:
    """The record that stands for a version block."""
    name = r.fields["URL"].removeprefix("filedesc://")
    body = f"software: lodestone\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version {r.version}\r\n".encode()
    return WarcRecord({
        "WARC-Type": "warcinfo",
        "WARC-Record-ID": record_id(f"{name} {r.fields['Archive-date']}"),
        "WARC-Date": iso_date(r.fields["Archive-date"]),
        "WARC-Filename": name,
        "WARC-Block-Digest": f"sha256:{sha256(body).hexdigest()}",
        "Content-Type": "application/warc-fields",
        "Content-Length": str(len(body)),
    }, body)


@dataclass
class Referred:
    """What is known of a record that others refer to: its page, address and ARC date; with the payload's digest, its identity."""

    page: object
    url: str
    date: str

    def record_id(self, digest: str) -> str:
        return record_id(f"page {self.page} {_line(self.url)} {self.date} {digest}")


def convert(r: ArcRecord, place: str, refers_to: Referred | None = None, known_as: Referred | None = None) -> WarcRecord:
    """The WARC record equivalent to an ARC record; with ``refers_to``, a revisit of that record's payload, which it keeps the digest of.

    place: file and offset of the ARC record; known_as: where others refer to this one.
    """
    http = http_parts(r.content)
    head, payload = http or (b"", r.content)
    digest, revisit = sha256(payload).hexdigest(), refers_to is not None
    block = head if revisit else r.content
    headers = {
        "WARC-Type": "revisit" if revisit else "response" if http else "resource",
        "WARC-Record-ID": known_as.record_id(digest) if known_as else record_id(f"{place} {r.fields['URL']} {r.fields['Archive-date']} {digest}"),
        "WARC-Date": iso_date(r.fields["Archive-date"]),
        "WARC-Target-URI": r.fields["URL"],
        "WARC-IP-Address": r.fields["IP-address"],
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{sha256(block).hexdigest()}",
        "WARC-Identified-Payload-Type": r.fields["Content-type"],
    }
    if revisit:
        headers |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": refers_to.record_id(digest),
            "WARC-Refers-To-Target-URI": _line(refers_to.url),
            "WARC-Refers-To-Date": iso_date(refers_to.date),
        }
    headers |= {"Content-Type": _HTTP if http else r.fields["Content-type"], "Content-Length": str(len(block))}
    return WarcRecord(headers, block)


def read_warc(stream: io.BufferedIOBase) -> Iterator[WarcRecord]:
    """Records of an uncompressed WARC stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            headers[k] = v
        block = stream.read(int(headers["Content-Length"]))
        if sha256(block).hexdigest() != headers["WARC-Block-Digest"].removeprefix("sha256:"):
            raise ValueError(f"{headers['WARC-Record-ID']}: its block doesn't have its digest")
        digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha256:")
        r = WarcRecord(headers, block, digest)
        if headers["WARC-Type"] in ("response", "resource") and sha256(r.payload).hexdigest() != digest:
            raise ValueError(f"{headers['WARC-Record-ID']}: its payload doesn't have its digest")
        yield r


def arc_of(rows: Iterable[tuple], version: int, name: str = "pages.arc", date: str = DATE) -> bytes:
    """An ARC file of (url, content) rows, or (url, content, date) ones."""
    return arc_version_block(version, name, date) + b"".join(arc_record(version, u, own[0] if own else date, "text/html", c) for u, c, *own in rows)


def assign_types(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, digest, refers_to, refers_url, refers_date) of each page whose payload more than one has: what they refer to, the first of them to itself.

    Small rows without payloads go through the aggregation, which combines before its
    exchange, and the join on the digest; digests that occur once leave early, and the
    pages of one digest are spread by a salt.
    """
    spread = 16
    mine = pages.filter(F.octet_length("payload") >= least).select("page_id", "url", "date", "digest")
    first = mine.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date"))).alias("to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null")
    first = first.select("digest", "refers_to", F.col("to.url").alias("refers_url"), F.col("to.date").alias("refers_date"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"))
    salted = mine.select("page_id", "digest").distinct().withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(spread)).cast("int"))
    return salted.join(first, ["digest", "salt"]).select("page_id", "digest", "refers_to", "refers_url", "refers_date")


INDEX = "path string, offset long, size long, record_id string, page_id long, page boolean"


def write(pages: DataFrame, folder: str, least: int = 100, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", date_column: str | None = None) -> DataFrame:
    """Archive a table of pages through ARC records; returns the index of the WARC files: (path, offset, size, record_id, page_id, page), warcinfo being no page.

    date_column: 14 digits of each page's crawl date, DATE where there is none.

    Each task converts ARC files of many records and writes compressed files of its own,
    one member a record, under a name of its attempt that it renames when the file is whole.
    """
    column = lambda name: cluster.at(pages, name)
    src = cluster.by_position(pages).select(column(id_column).cast("long").alias("page_id"), F.coalesce(column(url_column).cast("string"), F.lit("-")).alias("url"), F.coalesce(column(payload_column).cast("string"), F.lit("")).cast("binary").alias("payload"), (F.coalesce(column(date_column).cast("string"), F.lit(DATE)) if date_column else F.lit(DATE)).alias("date"))
    src = src.withColumn("digest", F.sha2("payload", 256))
    types = assign_types(src, least).withColumnRenamed("page_id", "revisit_id").withColumnRenamed("digest", "revisit_digest")
    typed = src.join(types, (src.digest == types.revisit_digest) & src.page_id.eqNullSafe(types.revisit_id), "left")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = cluster.open_folder(folder)
        context = TaskContext.get()
        number, out, arcs, size = 0, None, 0, 0
        made: list[tuple] = []  # of the file that is being written; a batch of index rows when it is whole
        ready: list[list[tuple]] = []
        name = ""
        referred: set[str] = set()

        def finish() -> None:
            out.close()
            store.move(f"{name}.tmp", name)
            ready.append(list(made))
            made.clear()

        def put(r: WarcRecord, page: int | None, is_page: bool) -> None:
            nonlocal size
            data = gzip.compress(r.dump(), 1, mtime=0)
            out.write(data)
            made.append((name, size, len(data), r.headers["WARC-Record-ID"], page, is_page))
            size += len(data)

        def index() -> Iterator[pa.RecordBatch]:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            for rows in ready:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "offset", "size", "record_id", "page_id", "page"])
            ready.clear()

        def convert_all(rows: list[tuple]) -> None:
            """One ARC file a version, of all rows given."""
            nonlocal out, number, name, arcs, size
            for version in (1, 2):
                mine = [r for r in rows if (r[0] or 0) % 2 == version % 2]
                if not mine:
                    continue
                if out is None:
                    store.create_dir(path, recursive=True)
                    name = f"{path}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.gz"
                    out, size = store.open_output_stream(f"{name}.tmp", compression=None), 0
                arc, arcs = f"{name.rsplit('/', 1)[1].removesuffix('.warc.gz')}-{arcs:04d}.arc", arcs + 1
                block, *records = read_arc(arc_of([(url, with_head(payload), date) for _, url, payload, date, *_ in mine], version, arc), block=True)
                put(warcinfo(block), None, False)
                for i, (r, (key, url, _, date, refers, refers_url, refers_date)) in enumerate(zip(records, mine, strict=True)):
                    to = None if refers is None else Referred(refers, refers_url, refers_date)
                    revisit = to is not None and key != refers
                    # Of equal rows that others could mean, the first one here is meant.
                    known = to if to is not None and not revisit and (url, date) == (refers_url, refers_date) else None
                    if known is not None:
                        mark = known.record_id(sha256(http_parts(r.content)[1]).hexdigest())
                        known = None if mark in referred else known
                        referred.add(mark)
                    put(convert(r, f"{arc} {i}", to if revisit else None, known), key, True)
                if size >= _PAGE_SIZE * 8:
                    finish()
                    out, number = None, number + 1

        for batch in cluster.batches(it, 500):
            rows, held = [], 0
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                rows.append(row)
                held += len(row[2])
                if held > _PAGE_SIZE:
                    convert_all(rows)
                    rows, held = [], 0
            convert_all(rows)
            yield from index()
        if out is not None:
            finish()
        yield from index()

    return cluster.cut(typed.select("page_id", "url", "payload", "date", "refers_to", "refers_url", "refers_date").mapInArrow(run, INDEX))


def files_of(index: DataFrame) -> DataFrame:
    """(path, n_records, n_bytes) of the files of an index."""
    return index.groupBy("path").agg(F.count_if("page").alias("n_records"), F.sum("size").alias("n_bytes"))


def read(files: DataFrame, folder: str) -> DataFrame:
    """The records of WARC files but their warcinfo, as they say themselves: (record_id, url, date, payload_bytes, payload_digest, record_type, refers_record, payload); a revisit has no payload and no length."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = cluster.open_folder(folder)
        columns = ["record_id", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_record", "payload"]
        for batch in it:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with store.open_input_stream(path, compression=None) as raw, gzip.open(raw) as f:
                    for r in read_warc(f):
                        h = r.headers
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        revisit = h["WARC-Type"] == "revisit"
                        rows.append((h["WARC-Record-ID"], h["WARC-Target-URI"], h["WARC-Date"], None if revisit else len(r.payload), r.payload_digest, h["WARC-Type"], h.get("WARC-Refers-To"), r.payload))
                        held += len(r.block)
                        if held > _PAGE_SIZE:
                            yield _batch(rows, columns)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, columns)

    n = max(1, files.count())
    return files.select("path").repartition(n).mapInArrow(run, "record_id string, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_record string, payload binary")


SPREAD = 16  # rows that a referred record is joined from, so that revisits of one record are dealt out


def resolved(records: DataFrame, index: DataFrame) -> DataFrame:
    """Records as ``read`` gives them, without payloads, with page_id and refers_to, by the index, and a revisit's payload_bytes, by the record that it refers to."""
    records = cluster.saved(records.drop("payload"), "records")  # read once
    place = index.filter("page").select("record_id", "page_id")
    named = records.join(place, "record_id")
    # Of what revisits refer to: identifiers first, so that few records are dealt out.
    wanted = records.filter("refers_record is not null").select(F.col("refers_record").alias("record_id")).distinct()
    meant = named.select("record_id", "page_id", "payload_bytes").join(wanted, "record_id", "left_semi")
    meant = meant.select(F.col("record_id").alias("refers_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("own_bytes"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    out = named.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SPREAD)).cast("int")).join(meant, ["refers_record", "salt"], "left")
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "own_bytes")).drop("salt", "own_bytes")


def _batch(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], columns)


def archive(pages: DataFrame, folder: str | None = None, least: int = 100, date_column: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Write and read back; returns the files, the records without their payloads (``read`` has them) and the folder."""
    folder = folder or cluster.scratch(pages.sparkSession, "warc")
    index = write(pages, folder, least, date_column=date_column)
    files = files_of(index)
    return files, resolved(read(files, folder), index), folder

