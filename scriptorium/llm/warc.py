"""WARC: a converter of legacy ARC archives, and archives written and read by Spark's own sinks.

ARC records begin with a line of fields that depends on the file's version: version 1 has URL, IP, date,
content type and length; version 2 adds result code, checksum, location, offset and file name before the
length. The converter finds records by these lines and their declared lengths, drops the filedesc record
and synthesises for each a WARC record: a name-based UUID from URL, date and digest as identifier, an ISO
timestamp from the 14 digits, type, SHA-1 block and payload digests in base32.

Archives are files of plain or gzipped WARC records in the shared folder, written by the text sink with
the records' closing CR LF CR LF as line separator, and read by the text source with the same separator,
so any store Spark reaches will do. Spark cuts plain files wherever it likes: those are read by line feeds, whose
pieces are the same however a file is cut, and brought back in order, a file a task. Records are put together
by their declared lengths, one at a time: a payload may hold the separator, and memory follows the longest
record, not the file.

Records with equal payloads have one response, that with the largest page_id; the others are revisits
without a payload of their own. Equal payloads are found by a SHA-1 digest, summed up before anything is
shuffled. A null html is an empty payload; a null page_id is below all others; repeated rows of the
largest page_id are all responses.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import fresh_path, ship

#: Payloads of at least so many bytes may be revisits.
REVISIT_BYTES = 0
SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields of a record's line by version.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "filename", "length"),
}


@dataclass(frozen=True)
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str
    mime: str
    block: bytes


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_arc(records: Iterable[tuple[str, str, str, str, bytes]], version: int, name: str = "made.arc") -> bytes:
    """An ARC file of (url, ip, date, mime, block). Blanks and control characters in URLs are percent-encoded."""
    described = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = f"{version} {0 if version == 1 else 1} scriptorium\n{described}\n\n".encode()
    extra = "" if version == 1 else f"200 - - 0 {name} "
    out = bytearray(f"filedesc://{name} 0.0.0.0 20000101000000 text/plain {extra}{len(body)}\n".encode() + body)
    for url, ip, date, mime, block in records:
        url = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or "unknown:"
        more = "" if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - {len(out)} {name} "
        out += f"{url} {ip} {date} {mime} {more}{len(block)}\n".encode() + block + b"\n"
    return bytes(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file but its filedesc. Raises ValueError where a line or a length doesn't fit."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line doesn't end")
        values = data[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        if version is None:
            version = int(data[end + 1 : end + 2] or b"0") if values[0].startswith("filedesc:") else 1 if len(values) == 5 else 2
        names = FIELDS.get(version)
        if names is None or len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line of version {version}: {values}")
        own = dict(zip(names, values, strict=True))
        block = data[end + 1 : end + 1 + int(own["length"])]
        if len(block) != int(own["length"]):
            raise ValueError("an ARC record is shorter than its declared length")
        at = end + 1 + len(block)
        if not own["url"].startswith("filedesc:"):
            yield ArcRecord(version, own["url"], own["ip"], own["date"], own["mime"], block)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload of a block; a block without a head is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, gap, payload = block.partition(b"\r\n\r\n")
    return head + gap, payload


def warc_date(date: str) -> str:
    """14 digits (fewer: completed with the lowest) as an ISO timestamp."""
    full = (date + "19700101000000"[len(date) :])[:14]
    return datetime.datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def to_warc(record: ArcRecord, kind: str | None = None, refers_to: str | None = None, extra: dict[str, str] | None = None) -> bytes:
    """A WARC record without its closing CR LF CR LF. kind: response, resource or revisit; by default what the block looks like."""
    head, payload = split_http(record.block)
    kind = kind or ("response" if head else "resource")
    digest = digest_of(payload)
    block = head if kind == "revisit" else record.block
    identity = uuid.uuid5(uuid.NAMESPACE_URL, f"{record.url} {record.date} {digest} {(extra or {}).get('X-Page-Id', '')}")
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{identity}>", "WARC-Date": warc_date(record.date), "WARC-Target-URI": record.url, "WARC-IP-Address": record.ip}
    fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{digest_of(block)}", "X-Payload-Length": str(len(payload))}
    if kind == "revisit":
        fields |= {"WARC-Profile": PROFILE} | ({"X-Refers-To-Page": refers_to} if refers_to else {})
    fields |= (extra or {}) | {"Content-Type": "application/http;msgtype=response" if head else record.mime, "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block


def parse_warc(parts: Iterable[bytes], between: str = SEPARATOR) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, from the pieces of a file that between has parted, in order."""
    gap, buffer, need, fields = SEPARATOR.encode(), bytearray(), 0, None
    for part in parts:
        buffer += part
        buffer += between.encode()
        while True:
            if fields is None:
                start = len(buffer) - len(buffer.lstrip(b"\r\n"))  # a payload that ends in CR LF shifts the pieces
                end = buffer.find(gap, start)
                if end < 0:
                    break
                lines = buffer[start:end].decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record where one should begin: {lines[0][:80]!r}")
                fields = dict(x.split(": ", 1) for x in lines[1:])
                need = int(fields["Content-Length"])
                del buffer[: end + len(gap)]
            if len(buffer) < need + len(gap):
                break
            if buffer[need : need + len(gap)] != gap:
                raise ValueError("a WARC record doesn't end where its declared length says")
            yield fields, bytes(buffer[:need])
            del buffer[: need + len(gap)]
            fields = None
    if fields is not None or buffer.strip(b"\r\n"):
        raise ValueError("a WARC record is shorter than its declared length")


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base32, from the hexadecimal digits by eights of letters."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_originals(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the page whose payload a revisit has; null for responses."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_digest", base32_sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= REVISIT_BYTES
    groups = rows.where(large).groupBy("_digest").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = rows.withColumn("_large", large).join(groups, "_digest", "left")
    other = F.col("_large") & F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("_last")).alias("refers_to"))


def archive(pages: DataFrame, path: str) -> None:
    """Write pages as WARC files under path. Each page becomes an ARC record of version 1 or 2, by turns, which the converter turns into a WARC record."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        epoch = datetime.datetime(2001, 1, 1)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n = r["page_id"]
                date = (epoch + datetime.timedelta(seconds=(n or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(html := r['html'].encode())}\r\n\r\n"
                arc = make_arc([(r["url"] or "unknown:", "0.0.0.0", date, "text/html", head.encode() + html)], 1 + (n or 0) % 2)
                refers, page = r["refers_to"], {} if n is None else {"X-Page-Id": str(n)}
                out += [to_warc(a, None if refers is None else "revisit", None if refers is None else str(refers), page) for a in parse_arc(arc)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = with_originals(pages).mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC files under path, plain or gzipped (named .gz); payload is null for revisits."""
    ship(spark)
    columns = "page_id bigint, url string, date string, record_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    names = [c.split()[0] for c in columns.split(", ")]

    def records(batches: Iterator[pa.RecordBatch], between: str) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64() if c.endswith("bigint") else pa.binary() if c.endswith("binary") else pa.string() for c in columns.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows, size = [], 0
        for fields, block in parse_warc((v for b in batches for v in b.column(0).to_pylist()), between):
            if fields.get("WARC-Block-Digest") != f"sha1:{digest_of(block)}":
                raise ValueError("a block doesn't have its digest")
            kind, payload = fields["WARC-Type"], split_http(block)[1]
            digest, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
            if kind != "revisit":
                digest, n = digest_of(payload), len(payload)
            number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
            rows.append((number("X-Page-Id"), fields["WARC-Target-URI"], fields["WARC-Date"], fields["WARC-Record-ID"], n, digest, kind, number("X-Refers-To-Page"), None if kind == "revisit" else payload))
            size += len(payload)
            if len(rows) >= 2000 or size > 4_000_000:
                yield told(rows)
                rows, size = [], 0
        if rows:
            yield told(rows)

    def pieces(between: str, gzipped: bool) -> DataFrame:
        lines = spark.read.option("lineSep", between).text(path).where(F.col("_metadata.file_name").endswith(".gz") == F.lit(gzipped))
        return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    files = spark.read.text(path).inputFiles()
    found = pieces(SEPARATOR, True).select("value").mapInArrow(lambda b: records(b, SEPARATOR), columns)
    if all(f.endswith(".gz") for f in files):
        return found
    ordered = pieces("\n", False).withColumn("place", F.monotonically_increasing_id()).repartition("file").sortWithinPartitions("file", "start", "place")
    return found.union(ordered.select("value").mapInArrow(lambda b: records(b, "\n"), columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives and read them back, as (page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, date)."""
    path = fresh_path(pages.sparkSession, "warc")
    archive(pages, path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date")
