"""Legacy ARC archives: written, read by version and declared lengths, and converted to WARC with equivalent records.

An ARC file begins with a record that names its version and the fields of the header lines that follow; version 1 has
five fields, version 2 ten. Each header line declares the length of its record. The converter synthesises what a WARC
record has beyond that: identifier, ISO timestamp, type, content type and digests. Payloads that were archived before
become revisit records. Archives are files of bounded size in the shared folder, written and read by Spark.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_path, written

FILE_BYTES = 8 << 20  # an archive is closed when it is larger
HOST, TOOL = "0.0.0.0", "archive converter 1.0"
# fixed values: header fields by version
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
DATE = "20000101000000"  # pages have no time of their own
RECORD = "url string, date string, mime string, http string, payload binary, page_id bigint, record_id string, payload_bytes bigint, payload_digest string, block_digest string"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _files(parts: Iterator[bytes], head: bytes) -> Iterator[str]:
    """Archives of about FILE_BYTES, each with head in front."""
    held, size = [head], len(head)
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= FILE_BYTES:
            yield b"".join(held)
            held, size = [head], len(head)
    if len(held) > 1:
        yield b"".join(held)


def _stored(rows: DataFrame, make, kind: str, end: str) -> str:
    """Runs make over the batches of rows, which gives archives, and writes each as one gzip file; end is what every archive ends with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in make(batches):
            # the text sink writes the bytes of strings as they are
            yield pa.RecordBatch.from_arrays([pa.array([data.removesuffix(end.encode())], pa.binary())], names=["file"])

    path = new_path(rows.sparkSession, kind)
    files = rows.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)
    return path


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = zlib.decompress(content.as_py(), 31)
            if data:  # an empty table leaves an empty file
                yield name, data


def write_arc(pages: DataFrame) -> str:
    """Archives pages(page_id, url, html) as ARC files, of either version in turn by partition; gives their folder.

    The record is an HTTP response with the page's id as a header and the html in UTF-8 as payload; null html is empty. In a
    header line blanks in the url are escaped and a null url is a dash.
    """

    def make(batches):
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        intro = f"{version} 0 archive\n{' '.join(FIELDS[version])}\n".encode()
        shape = {"URL": "filedesc://archive.arc", "IP-address": HOST, "Archive-date": DATE, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "archive.arc"}
        line = lambda values: " ".join(str(values[f]) for f in FIELDS[version]).encode() + b"\n"
        head = line(shape | {"Archive-length": len(intro)}) + intro

        def records():
            for batch in batches:
                for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = (html or "").encode()
                    known = "" if page is None else f"X-Page-Id: {page}\r\n"
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                    safe = "".join(f"%{ord(c):02X}" if c.isspace() else c for c in url) if url else "-"
                    yield b"\n" + line(shape | {"URL": safe, "Content-type": "text/html", "Archive-length": len(block), "Checksum": hashlib.md5(block).hexdigest()}) + block

        yield from (data + b"\n" for data in _files(records(), head))

    return _stored(pages.select("page_id", "url", "html"), make, "arc", "\n")


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record after the version block; fields are those that the version block names."""
    at = data.index(b"\n") + 1
    length = int(data[: at - 1].rsplit(b" ", 1)[1])
    version, _, fields = data[at : at + length].partition(b"\n")
    names = fields.split(b"\n")[0].decode().split() or list(FIELDS[int(version.split(b" ")[0])])
    at += length
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(names) - 1)
        header = dict(zip(names, values, strict=True))
        size = int(header[names[-1]])
        yield at, header, data[end + 1 : end + 1 + size]
        at = end + 1 + size


def _iso(date: str) -> str:
    d = date.ljust(14, "0")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _header(http: str, name: str) -> str | None:
    for line in http.split("\r\n")[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name:
            return value.strip()
    return None


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder of ARC files with what WARC records need; identifiers depend on file and offset, so reruns agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, data in _unpacked(batches):
            rows = []
            for offset, header, block in parse_arc(data):
                http, _, payload = block.partition(b"\r\n\r\n")
                http = http.decode("utf-8", "replace")
                page = _header(http, "x-page-id")
                rows.append((header["URL"], _iso(header["Archive-date"]), header["Content-type"], http, payload, int(page) if page else None,
                             str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{offset}")), len(payload), digest(payload), digest(block)))
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split(" ")[0] for c in RECORD.split(", ")])

    return _contents(spark, path).mapInArrow(run, RECORD)


def _record(kind: str, record_id: str, date: str, fields: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def to_warc(spark: SparkSession, arc: str, least: int = 0) -> str:
    """Converts a folder of ARC files to WARC files and gives their folder.

    Of records with equal payloads of at least least bytes, those with the smallest page id are responses, the others
    revisit the first of them; records without id come last. Payloads are shuffled once, by record.
    """
    light = written(read_arc(spark, arc).drop("payload", "http", "mime", "block_digest"), "arc-index")
    key = ["payload_digest", "payload_bytes"]
    first = light.where(F.col("payload_bytes") >= least).groupBy(*key).agg(
        F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "record_id", "url", "date")).alias("r"), F.count("*").alias("m")).where("m > 1").select(*key, "r")
    again = light.join(first, key).where(~F.col("page_id").eqNullSafe(F.col("r.page_id"))).select("record_id", F.struct("r.record_id", "r.page_id", "r.url", "r.date").alias("refers"))
    rows = read_arc(spark, arc).hint("merge").join(again.hint("merge"), "record_id", "left")
    names = ["record_id", "url", "date", "http", "payload", "payload_digest", "block_digest", "refers"]

    def make(batches):
        info = f"software: {TOOL}\r\nformat: WARC File Format 1.1\r\n".encode()
        head = _record("warcinfo", str(uuid.uuid5(uuid.NAMESPACE_URL, TOOL)), _iso(DATE), {"Content-Type": "application/warc-fields"}, info)

        def records():
            for batch in batches:
                for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    r = dict(zip(names, r, strict=True))
                    block = r["http"].encode() + b"\r\n\r\n"
                    fields = {"WARC-Target-URI": r["url"], "WARC-IP-Address": HOST, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{r['payload_digest']}"}
                    if r["refers"]:
                        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{r['refers']['record_id']}>",
                                   "WARC-Refers-To-Target-URI": r["refers"]["url"], "WARC-Refers-To-Date": r["refers"]["date"], "X-Refers-To-Page": r["refers"]["page_id"]}
                        yield _record("revisit", r["record_id"], r["date"], fields, block)
                    else:
                        yield _record("response", r["record_id"], r["date"], fields | {"WARC-Block-Digest": f"sha1:{r['block_digest']}"}, block + r["payload"])

        return _files(records(), head)

    return _stored(rows.select(*names), make, "warc", "\r\n\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        header = {}
        for line in data[at:end].decode().split("\r\n")[1:]:
            key, _, value = line.partition(":")
            header[key.strip().lower()] = value.strip()
        size = int(header["content-length"])
        yield header, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id of the responses and revisits in a folder of WARC files.

    Bytes and digest are those of the full payload: computed from a response's block, taken from a revisit's headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in _unpacked(batches):
            rows = []
            for h, block in parse_warc(data):
                if h["warc-type"] in ("response", "revisit"):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    http = http.decode("utf-8", "replace")
                    page, refers, whole = _header(http, "x-page-id"), h.get("x-refers-to-page"), h["warc-type"] == "response"
                    rows.append((int(page) if page else None, len(payload) if whole else int(_header(http, "content-length") or 0),
                                 digest(payload) if whole else h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], int(refers) if refers else None, h["warc-target-uri"], h["warc-record-id"]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id"])

    return _contents(spark, path).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, record_id string")


def archive_report(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages archived, converted and read back: page_id, payload_bytes, payload_digest, record_type, refers_to of every row.

    Rows of one id and one payload are all responses if that id is the smallest. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    return read_warc(spark, to_warc(spark, write_arc(pages), least)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
