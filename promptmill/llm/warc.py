"""WARC archives: one record per page, copies as revisits, and a reader that salvages damaged files.

The writer uses Spark's text sink: a record is a line of it, and the line separator is the empty
lines that end a record, so any file system that Spark writes to will do. Files are kept to about
``FILE_BYTES``. The reader takes plain records and gzip members alike. Where a check fails (version
line, header, length, end of record, checksum of a member, digest) it looks for the next version
line or member that does hold, goes on there, and logs the bytes in between as a gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.llm.tasks import arrow_map
from promptmill.session import cut_lineage

FILE_BYTES = 16 << 20
FILE_LIMIT = 1 << 30  # readers take a file as one value
REVISIT_BYTES = 1000  # shorter payloads are always stored
DATE = "2026-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _named(id: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(id.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One WARC record (column ``value``, without the empty lines that end it) per row, with ``bytes`` of its payload.

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of at least
    ``REVISIT_BYTES`` those with the largest id are responses, the others (also those without an
    id) revisits of it; where no id is known all are responses. Only digests meet in a shuffle.
    """
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), text.alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    several = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 and kept is not null")
    several = cut_lineage(several.select("digest", "kept"), "copies")
    typed = rows.join(several, "digest", "left").withColumn("again", F.coalesce(F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept")), F.lit(False)))
    common = F.concat(
        _header("WARC-Record-ID", _named(F.col("id"))), _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), _header("X-Payload-Length", F.col("bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"))
    block = F.concat(F.lit(HTTP), F.when(F.col("again"), F.lit("")).otherwise(F.col("html")))
    value = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("again"), F.lit("revisit\r\n")).otherwise(F.lit("response\r\n")), common,
        F.when(F.col("again"), F.concat(_header("WARC-Refers-To", _named(F.col("kept"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(F.lit("")),
        _header("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    return typed.select("id", "digest", value.alias("value"))


def write(pages: DataFrame, out: str, **columns: str) -> None:
    """Write the pages' records to files of about ``FILE_BYTES`` in ``out``, from where the pages are read.

    The records per file follow from the average size, and from the greatest one, so that no file can pass ``FILE_LIMIT``.
    """
    html, url = (F.coalesce(F.octet_length(F.col(columns.get(c, c)).cast("string")), F.lit(0)).cast("bigint") for c in ("html", "url"))
    size = html + url * 3 + 700
    average, greatest = pages.agg(F.avg(size), F.max(size)).first()
    several = int(max(1, min(FILE_BYTES // (average or 1), FILE_LIMIT // (greatest or 1))))
    records(pages, **columns).select("value").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", several).text(out)


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block without its HTTP header, if it has one."""
        if self.block.startswith(b"HTTP/"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Damaged(Exception):
    pass


_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_MEMBER = b"\x1f\x8b\x08"
_CANDIDATE = re.compile(rb"WARC/\d+\.\d+\r\n|\x1f\x8b\x08")


def _plain(data: bytes, at: int) -> Record:
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", version.end() - 2)
    if head_end < 0:
        raise Damaged("header without an end")
    headers: dict[str, str] = {}
    for line in data[version.end(): head_end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without a colon")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Damaged("no content length")
    begin = head_end + 4
    end = begin + int(length)
    if data[end: end + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    record = Record(at, end + 4, headers, data[begin:end])
    stated = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and re.fullmatch("sha1:[0-9a-f]{40}", stated) and hashlib.sha1(record.payload).hexdigest() != stated[5:]:
        raise Damaged("payload digest differs")
    return record


def _member(data: bytes, at: int) -> list[Record]:
    machine = zlib.decompressobj(31)
    try:
        inner = machine.decompress(memoryview(data)[at:])
    except zlib.error as e:
        raise Damaged(f"gzip member: {e}") from None
    if not machine.eof:
        raise Damaged("gzip member without an end")
    end, found, place = len(data) - len(machine.unused_data), [], 0
    while place < len(inner):
        record = _plain(inner, place)
        place = record.end
        found.append(Record(at, end, record.headers, record.block))
    return found


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of a file in order, and the gaps between them."""
    at, lost, reason = 0, -1, ""
    while at < len(data):
        try:
            found = _member(data, at) if data.startswith(_MEMBER, at) else [_plain(data, at)]
        except Damaged as e:
            if lost < 0:
                lost, reason = at, str(e)
            more = _CANDIDATE.search(data, at + 1)
            at = more.start() if more else len(data)
            continue
        end = found[-1].end if found else len(data) - len(_rest(data, at))
        if lost >= 0:
            yield Gap(lost, at, reason)
            lost = -1
        yield from found
        at = end
    if lost >= 0:
        yield Gap(lost, len(data), reason)


def _rest(data: bytes, at: int) -> bytes:
    machine = zlib.decompressobj(31)  # an empty member
    machine.decompress(memoryview(data)[at:])
    return machine.unused_data


SCHEMA = (
    "kind string, file string, start bigint, end bigint, reason string, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_bytes bigint, payload_digest string, payload binary")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of kind ``record``, and of kind ``gap`` for bytes that no valid record covers, of every file in ``path``.

    ``payload_bytes`` and ``payload_digest`` are computed from a response's payload; a revisit states
    those of the record that it refers to. ``payload=False`` leaves the payloads out.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[tuple] = []
                held = 0
                for x in salvage(content.as_py()):
                    if isinstance(x, Gap):
                        rows.append(("gap", name, x.start, x.end, x.reason, *[None] * 7))
                        continue
                    h, body = x.headers, x.payload
                    held += len(body)
                    again = h.get("warc-type") == "revisit"
                    stated = h.get("x-payload-length", "")
                    rows.append((
                        "record", name, x.start, x.end, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"),
                        (int(stated) if stated.isdigit() else None) if again else len(body),
                        h.get("warc-payload-digest", "").removeprefix("sha1:") or None if again else hashlib.sha1(body).hexdigest(), body if payload else None))
                    if payload and held > FILE_BYTES or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return arrow_map(files, run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def page_number(urn: Column) -> Column:
    """Id of a page from the name of its record."""
    return F.nullif(F.regexp_extract(urn, f"^<{URN}(.*)>$", 1), F.lit("")).try_cast("bigint")
