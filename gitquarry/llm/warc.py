"""Web archives: writing, normalising to one gzip member per record, reading.

``write_monolithic`` writes records into gzip files that are one stream each,
as many crawlers do; such a file can only be read from its beginning.
``normalise`` inflates each of them once, from front to back, and rewrites
every record as a gzip member of its own, with a sidecar index (file, offset,
length, record id, type), so that any record can be read alone.  ``read``
reads archives of either kind.

Files are written by Spark's own writers, so any store that Spark reaches will
do and a repeated task replaces its files.  The text writer ends each row with
a line separator; for monolithic files that is the CRLF CRLF which ends a
record anyway, for normalised ones an empty gzip member, which readers skip.

Scale: records are streamed; a task holds the compressed bytes of one archive
file and one record.  Archive files are as large as an input partition.
Equal payloads are found by an aggregation and a join on their digests, of
which adaptive execution splits hot ones.

Defined cases: a null html is an empty payload.  A null page_id becomes the
record id ``none``; it is never a revisit's target unless a group has no other.
Rows repeating a page_id and payload: the row is listed as often as it occurs,
and a repeated winner is a response each time.  Urls are written
percent-encoded where they hold white space or controls, null as empty.
Further columns are ignored.  An empty table gives empty archives and no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitquarry.llm.common import batches, stored

LEAST_REVISIT = 1000
_END = b"\r\n\r\n"
# Fixed value: a gzip member without content.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_DATE = "2024-01-01T00:00:00Z"
_PIECE = 1 << 20
_READ_BYTES = 1 << 14


def _digests(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(stream):
        payloads = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(p) for p in payloads], pa.int64()),
             pa.array([hashlib.sha1(p).hexdigest() for p in payloads]), pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary())],
            names=["page_id", "payload_bytes", "sha1", "sha256"])


def revisits(pages: DataFrame, id_col: str, html_col: str, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """(sha256, response): digests of payloads of ``least_bytes`` or more that
    several rows hold, and the largest page_id of those."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    id_type = rows.schema["page_id"].dataType.simpleString()
    digests = rows.mapInArrow(_digests, f"page_id {id_type}, payload_bytes long, sha1 string, sha256 binary")
    return (digests.where(F.col("payload_bytes") >= least_bytes).groupBy("sha256")
            .agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("sha256", "response"))


def record(kind: str, record_id: str, url: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A WARC record without the CRLF CRLF that ends it.  A revisit carries
    the digest and length of the payload it leaves out."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", f"WARC-X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if kind == "response" else b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + _END + body


def _url(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def _records(least_bytes: int):
    def records(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 64):
            out = []
            for page_id, url, html, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload, name = (html or "").encode(), "none" if page_id is None else str(page_id)
                again = len(payload) >= least_bytes and response is not None and response != page_id
                out.append(record("revisit" if again else "response", name, _url(url), payload, str(response) if again else None).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
    return records


def write_monolithic(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                     least_bytes: int = LEAST_REVISIT) -> None:
    """Write a record per row into gzip files under ``path``, one stream each."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    known = stored(revisits(pages, id_col, html_col, least_bytes))
    keyed = rows.withColumn("sha256", F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)))
    linked = keyed.join(known, "sha256", "left").select("page_id", "url", "html", "response")
    (linked.mapInArrow(_records(least_bytes), "value string")
     .write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path))


@dataclass
class Record:
    """A record's headers (names in lower case) and block."""

    headers: dict[str, str]
    block: bytes
    raw: bytes


class RecordStream:
    """Cuts an inflated stream into records; ``feed`` takes its bytes in
    pieces of any size and gives the records that they complete."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.need = 0  # bytes that the next record has at least

    def feed(self, piece: bytes) -> Iterator[Record]:
        self.held += piece
        at = 0
        while len(self.held) - at >= self.need:
            end = self.held.find(_END, at)
            if end < 0:
                self.need = len(self.held) - at + 1
                break
            lines = bytes(self.held[at:end]).decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
            headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = end + 4 + int(headers["content-length"]) + 4 - at
            if len(self.held) - at < size:
                self.need = size
                break
            raw = bytes(self.held[at:at + size])
            if raw[-4:] != _END:
                raise ValueError("a record's length is wrong")
            yield Record(headers, raw[end + 4 - at:-4], raw)
            at += size
            self.need = 1
        del self.held[:at]

    def end(self) -> None:
        if self.held:
            raise ValueError("the last record is cut off")


def inflate(content: bytes) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of one or many members, in pieces."""
    view = memoryview(content)
    at = 0
    while at < len(view):
        if view[at:at + len(EMPTY_MEMBER)] == EMPTY_MEMBER:
            at += len(EMPTY_MEMBER)
            continue
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            if at >= len(view):
                raise ValueError("the gzip stream is cut off")
            piece = data = view[at:at + _READ_BYTES]
            while True:
                out = member.decompress(data, _PIECE)
                if out:
                    yield out
                data = member.unconsumed_tail
                if member.eof or not data and len(out) < _PIECE:
                    break
            at += len(piece) - len(member.unused_data)


def parse(content: bytes) -> Iterator[Record]:
    stream = RecordStream()
    for piece in inflate(content):
        yield from stream.feed(piece)
    stream.end()


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _members(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files to one gzip member per record, in order."""
    for batch in batches(stream, 1):
        rows, held = [], 0
        for found in parse(batch.column(1)[0].as_buffer()):
            rows.append(_member(found.raw))
            held += len(rows[-1])
            if held > _PIECE:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["member"])
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["member"])


_INDEX = "file string, offset long, length long, record_id string, type string"


def _index(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of one member per record to the members' places."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string())])
    for batch in batches(stream, 1):
        name, content, at, rows = batch.column(0)[0].as_py().rpartition("/")[2], memoryview(batch.column(1)[0].as_buffer()), 0, []
        while at < len(content):
            end = at
            stream_of_member = zlib.decompressobj(wbits=31)
            raw = bytearray()
            while not stream_of_member.eof:
                piece = content[end:end + _READ_BYTES]
                raw += stream_of_member.decompress(piece)
                end += len(piece) - len(stream_of_member.unused_data)
            (found,) = RecordStream().feed(raw)
            rows.append({"file": name, "offset": at, "length": end - at, "record_id": found.headers["warc-record-id"], "type": found.headers["warc-type"]})
            at = end + len(EMPTY_MEMBER)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _files(spark: SparkSession, path: str, names: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("path", "content")


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite the gzip files under ``source``: archives go to
    ``target``/archive, their index to ``target``/index (a Parquet table)."""
    members = _files(spark, source, "*.gz").mapInArrow(_members, "member binary")
    (members.select(F.col("member").cast("string").alias("value"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(f"{target}/archive"))
    _files(spark, f"{target}/archive", "part-*").mapInArrow(_index, _INDEX).write.parquet(f"{target}/index")


_READ = "record_id string, type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def _read(with_payload: bool):
    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
        for batch in batches(stream, 1):
            rows, held = [], 0
            for found in parse(batch.column(1)[0].as_buffer()):
                h, full = found.headers, found.headers["warc-type"] == "response"
                digest = hashlib.sha1(found.block).hexdigest() if full else h["warc-payload-digest"].removeprefix("sha1:")
                if "sha1:" + digest != h["warc-payload-digest"]:
                    raise ValueError(f"{h['warc-record-id']}: the payload isn't what its digest says")
                rows.append({"record_id": h["warc-record-id"], "type": h["warc-type"], "url": h["warc-target-uri"],
                             "payload_bytes": len(found.block) if full else int(h["warc-x-payload-length"]), "payload_digest": digest,
                             "refers_to": h.get("warc-refers-to"), "payload": found.block if with_payload and full else None})
                held += len(found.block) if with_payload else 200
                if held > _PIECE:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
    return read


def read(spark: SparkSession, path: str, with_payload: bool = True, names: str = "*") -> DataFrame:
    """One row per record of the archives under ``path``: record_id, type,
    url, payload_bytes and payload_digest (of the full payload), refers_to,
    payload (null for revisits)."""
    return _files(spark, path, names).mapInArrow(_read(with_payload), _READ)


def page_of(record_id, id_type: str = "long"):
    """The page_id in a record id; null for ``none``."""
    return F.expr(f"try_cast(regexp_extract({record_id}, '^<urn:page:(.*)>$', 1) AS {id_type})")
