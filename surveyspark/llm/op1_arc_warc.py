"""Legacy archive converter: ARC files of versions 1 and 2 to WARC 1.0.

An ARC file begins with a version block ("filedesc://...", whose body names the version and the fields
of the header lines). Each record is one header line, content of the declared length, and a newline.
Version 1 has the fields URL, IP, date, type and length; version 2 URL, IP, date, type, result code,
checksum, location, offset, file name and length. Fields are read from the right, so that blanks in an
old URL do no harm. A WARC record gets a record id derived from its origin, an ISO date, a type by its
content (HTTP exchanges are responses, other content is a resource, a version block is warcinfo), and
SHA-1 digests in base 32 of block and payload. Records whose payload an earlier key has become
revisits, which keep the HTTP head only.

Files are written and read by Spark (text and binaryFile sources), one whole-gzip file for each task,
by Spark's commit protocol, so that they work on any store and survive lost executors. A file is read
by one task, so its size is bounded by that of its partition when written. Payloads move between tasks
once at most, in their ARC files as they are; which record is the first of its payload is settled on
digests, and each file meets the list of its revisits.

Defined cases: null html is an empty payload; a null or empty URL is "about:blank", blanks in URLs are
escaped; keys are the source's ids, null allowed: a record without key is a response unless a keyed one
has its payload, and rows with equal keys and payloads are equal in all; an empty table gives no
records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm.common import load, new_path, shared_dir, stored

FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
#: Records with payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
#: Bytes of rows that are handed on at once, about.
HANDED = 1 << 22
RECORD = "key string, url string, ip string, date string, mime string, version int, block binary"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


# --- ARC -------------------------------------------------------------------------------------------


def arc_header(version: int, url: str, ip: str, date: str, mime: str, n: int, status: str = "200", name: str = "-") -> bytes:
    """A header line of the version."""
    url = re.sub(r"\s", lambda m: "%%%02X" % ord(m[0]), url) or "about:blank"
    fields = [url, ip, date, mime] + ([status, "-", "-", "0", name] if version == 2 else []) + [str(n)]
    return " ".join(fields).encode("utf-8", "surrogateescape") + b"\n"


def arc_file(version: int, records: Iterator[tuple[str, str, str, str, bytes]], name: str) -> Iterator[bytes]:
    """The version block and one piece for each (url, ip, date, mime, content); pieces are joined and ended by newlines."""
    body = f"{version} 0 converter\n{FIELDS[version]}\n".encode()
    yield arc_header(version, f"filedesc://{name}", "0.0.0.0", "19960101000000", "text/plain", len(body), name=name) + body
    for url, ip, date, mime, content in records:
        yield arc_header(version, url, ip, date, mime, len(content), name=name) + content


def parse_arc(data: bytes) -> Iterator[tuple[int, str, str, str, str, bytes]]:
    """(version, url, ip, date, mime, content) of all records but version blocks, by declared lengths."""
    at, version, n = 0, 1, len(data)
    while at < n:
        end = data.find(b"\n", at)
        if end < 0:
            break
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        if not line.strip():
            at = end + 1
            continue
        head = line.startswith("filedesc://")
        if head:
            # Its own version shows in its body only; the length is last in both.
            length = int(line.rsplit(" ", 1)[1])
            version = int(data[end + 1 : end + 1 + length].split(b" ", 1)[0] or 1)
        else:
            parts = line.rsplit(" ", len(FIELDS[version].split()) - 1)
            length = int(parts[-1])
            yield version, parts[0], parts[1], parts[2], parts[3], data[end + 1 : end + 1 + length]
        at = end + 1 + length


# --- WARC ------------------------------------------------------------------------------------------


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload); no head if the block is no HTTP exchange."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def iso(date: str) -> str:
    """An ARC date (up to 14 digits) as WARC writes it."""
    d = (re.sub(r"\D", "", date) + "00000101000000"[len(re.sub(r"\D", "", date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, key: str | None, payload_digest: str) -> str:
    """The same for the same record, however often it is converted."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{url} {date} {key} {payload_digest}')}>"


def warc_record(headers: dict[str, str | None], block: bytes) -> bytes:
    """A record less the two line ends that close it."""
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogateescape") + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of all records, by declared lengths."""
    at = data.find(b"WARC/")
    while 0 <= at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:])
        stop = end + 4 + int(headers["Content-Length"])
        yield headers, data[end + 4 : stop]
        at = data.find(b"WARC/", stop, stop + 64)


def inflated(data: bytes) -> bytes:
    """All members of a gzip file, or the bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


# --- Spark -----------------------------------------------------------------------------------------


def write_pieces(pieces: DataFrame, path: str, end: str) -> None:
    """Column `piece` (binary) as gzip files, a file a task, each piece followed by `end`."""
    pieces.select(F.col("piece").cast("string").alias("value")).write.option("lineSep", end).option("compression", "gzip").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _handed(pieces: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """Pieces in batches of HANDED bytes, about."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size > HANDED:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["piece"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["piece"])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


def write_arc(records: DataFrame, path: str, rows_of: Callable[[pa.RecordBatch], Iterator[tuple]] = _rows) -> None:
    """Columns url, ip, date, mime, block, or what `rows_of` makes of other columns, as ARC files; every other file is of version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        yield from _handed(arc_file(1 + part % 2, (r for b in batches for r in rows_of(b)), f"part-{part:05d}.arc"))

    records = records.select("url", "ip", "date", "mime", "block") if rows_of is _rows else records
    write_pieces(records.mapInArrow(run, "piece binary"), path, "\n")


def _arc_rows(content: bytes) -> Iterator[tuple]:
    """RECORD of the records of an ARC file; key: what the HTTP head carries as X-Source-Key."""
    for version, url, ip, date, mime, block in parse_arc(inflated(content)):
        key = re.search(rb"\r\nX-Source-Key: ([^\r]*)", split_http(block)[0])
        yield key and key[1].decode(), url, ip, date, mime, version, block


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """key, url, ip, date, mime, version, block of the records of ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in _arc_rows(content.as_py()):
                    rows.append(row)
                    size += len(row[-1])
                    if size > HANDED:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return _files(spark, path).select("content").mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "url", "ip", "date", "mime", "version", "block"])


def digests(spark: SparkSession, source: str) -> DataFrame:
    """path, at (place in the file), key, url, date, digest and payload_bytes of all records of ARC files."""
    names, kinds = ["path", "at", "key", "url", "date", "digest", "payload_bytes"], [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                columns: list[list] = [[] for _ in names]
                for at, (key, url, _, date, _, _, block) in enumerate(_arc_rows(content.as_py())):
                    payload = split_http(block)[1]
                    for column, value in zip(columns, (path, at, key, url, date, digest(payload), len(payload)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return _files(spark, source).mapInArrow(run, "path string, at long, key string, url string, date string, digest string, payload_bytes long")


def _warc_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    first = True
    for batch in batches:
        for content, revisits in zip(*map(batch.column, ("content", "revisits")), strict=True):
            if first:
                first = False
                yield warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("warcinfo", "", None, ""), "WARC-Date": iso("19960101"), "Content-Type": "application/warc-fields"}, b"software: ARC converter\r\nformat: WARC File Format 1.0\r\n")
            of = {r["at"]: r["first"] for r in revisits.as_py() or ()}
            for at, (key, url, ip, date, mime, _, block) in enumerate(_arc_rows(content.as_py())):
                head, payload = split_http(block)
                sha, origin = digest(payload), of.get(at)
                if origin:
                    block = head
                headers = {
                    "WARC-Type": "revisit" if origin else "response" if head else "resource",
                    "WARC-Record-ID": record_id(url, date, key, sha), "WARC-Date": iso(date), "WARC-Target-URI": url, "WARC-IP-Address": ip,
                    "WARC-Payload-Digest": f"sha1:{sha}", "WARC-Block-Digest": f"sha1:{digest(block)}",
                    "Content-Type": "application/http; msgtype=response" if head else mime,
                    "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" if origin else None,
                    "WARC-Refers-To": record_id(origin["url"], origin["date"], origin["key"], sha) if origin else None,
                    "WARC-Truncated": None, "X-Source-Key": key, "X-Refers-To-Key": origin["key"] if origin else None, "X-Payload-Length": str(len(payload)),
                }
                yield warc_record(headers, block)


def _warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content of ARC files, revisits: place in the file, and key, url and date of the response) -> pieces."""
    return _handed(_warc_pieces(batches))


def arc_to_warc(spark: SparkSession, source: str, path: str, least_revisit: int = LEAST_REVISIT) -> None:
    """Convert the ARC files under `source` to WARC files under `path`.

    Keys are compared as numbers where they are numbers. The files are parsed twice, first for the
    digests of all, which are stored, and then, each with the list of its records that have become
    revisits, to be written anew.
    """
    records = stored(digests(spark, source), "digests")
    order = F.struct(F.col("key").cast("decimal(38,0)").isNull(), F.col("key").cast("decimal(38,0)"), "key")
    large = records.where(F.col("payload_bytes") >= least_revisit)
    first = large.where("key is not null").groupBy("digest").agg(F.min_by(F.struct("key", "url", "date"), order).alias("first"), F.count(F.lit(1)).alias("n"))
    keyless = records.where("key is null").select(F.col("digest").alias("d")).distinct()
    first = first.join(keyless, F.col("digest") == F.col("d"), "left").where("n > 1 or d is not null").select(F.col("digest").alias("of"), "first")
    revisits = large.join(first, F.col("digest") == F.col("of")).where(~F.col("first.key").eqNullSafe(F.col("key")))
    revisits = revisits.groupBy(F.col("path").alias("p")).agg(F.collect_list(F.struct("at", "first")).alias("revisits"))
    files = _files(spark, source)
    both = files.join(revisits, F.col("path") == F.col("p"), "left").select("content", "revisits")
    write_pieces(both.mapInArrow(_warc, "piece binary"), path, "\r\n\r\n")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """headers (a map) and block of all records of WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse_warc(inflated(content.as_py())):
                    rows.append((list(headers.items()), block))
                    size += len(block)
                    if size > HANDED:
                        yield _parsed(rows)
                        rows, size = [], 0
                if rows:
                    yield _parsed(rows)

    return _files(spark, path).select("content").mapInArrow(run, "headers map<string,string>, block binary")


def _parsed(rows: list[tuple]) -> pa.RecordBatch:
    headers, blocks = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(headers, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())], names=["headers", "block"])


def pages_as_arc(pages: DataFrame, path: str) -> None:
    """`pages` (page_id, url, html) as ARC files of HTTP exchanges; the page's id is in the head and gives the date."""

    write_arc(pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("binary")), path, _exchanges)


def _exchanges(batch: pa.RecordBatch) -> Iterator[tuple]:
    for key, url, body in _rows(batch):
        body = body or b""
        head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"] + ([] if key is None else [f"X-Source-Key: {key}"])
        date = datetime(1996, 1, 1, tzinfo=UTC) + timedelta(seconds=abs(key or 0) % 10**9)
        yield url or "about:blank", "0.0.0.0", date.strftime("%Y%m%d%H%M%S"), "text/html", "\r\n".join([*head, "", ""]).encode() + body


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to ARC files, those to WARC files, and these read back."""
    shared_dir(spark)
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    pages_as_arc(load(spark, sf_dir, "pages"), arc)
    arc_to_warc(spark, arc, warc)
    h = F.col("headers")
    rows = read_warc(spark, warc).where(h["WARC-Type"] != "warcinfo")
    return rows.select(
        h["X-Source-Key"].cast("long").alias("page_id"), h["X-Payload-Length"].cast("long").alias("payload_bytes"), F.substring_index(h["WARC-Payload-Digest"], ":", -1).alias("payload_digest"),
        h["WARC-Type"].alias("record_type"), h["X-Refers-To-Key"].cast("long").alias("refers_to"),
    )


SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x, first FROM p),
d AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(x, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
