"""WARC archives: a writer with revisit records, and a splittable reader.

Writer: every record is a gzip member of its own.  Of equal payloads of at least `least` bytes the one with the
smallest id is a response, the others are revisits that refer to it.  Members are joined to values of some megabytes
and written by Spark's text writer, which stores a string's bytes as they are and commits whole files to any file
system; a zero byte, which gzip allows as padding, follows each value.

Reader: files are cut into byte ranges, one task for each.  A task looks for the gzip magic from its range's start,
accepts a candidate if it decodes to a WARC header, and owns the records that start inside its range; it reads on past
the end to finish the last one.  Data that only looks like a member does not decode to a header and is passed over (a
payload that is itself a compressed archive and was stored without compression would be taken for records).

Defined results: a null payload is as an empty one; rows with equal id and payload are all responses; a null id is
written as "null", comes after all others and is read back as null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit

MAGIC = b"\x1f\x8b\x08"
LEAST, LEVEL, VALUE_BYTES, SPLIT_BYTES, READ_BYTES = 100, 3, 8 << 20, 8 << 20, 1 << 20


def _member(kind: str, page: str, refers_to: str | None, url: str, digest: str, payload: bytes, size: int) -> bytes:
    """A compressed record; a revisit's block holds the headers of its response alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + squeeze.flush()


def _members(batches):
    held, size = [], 0
    for batch in batches:
        raw, offs = kit.flat(batch["payload"])
        data, offs = memoryview(np.ascontiguousarray(raw)), offs.tolist()
        columns = [batch[c].to_pylist() for c in ("page", "first", "url", "digest")]
        for k, (page, first, url, digest) in enumerate(zip(*columns, strict=True)):
            payload = bytes(data[offs[k] : offs[k + 1]])
            kind = "response" if first is None or first == page else "revisit"
            held.append(_member(kind, page, first, url or "", digest, payload, len(payload)))
            size += len(held[-1])
            if size >= VALUE_BYTES:
                yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["value"])
                held, size = [], 0
    if held:
        yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["value"])


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_warc(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes page_id, url, html of each row as a record to files named *.warc.gz in a new folder."""
    spark = pages.sparkSession
    kit.bounded_batches(spark)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = kit.check_columns(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    alike = rows.where(F.octet_length("payload") >= least).groupBy(F.col("digest").alias("same")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(kit.small(kit.settled(alike)), F.col("digest") == F.col("same"), "left")  # payloads stay where they are if repeated digests are few
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    first = F.when(F.col("n").isNotNull(), F.coalesce(F.col("first").cast("string"), F.lit("null")))
    values = joined.select(name.alias("page"), first.alias("first"), "url", "digest", "payload").mapInArrow(kit.lean(_members), "value binary")
    values.select(F.col("value").cast("string")).write.option("lineSep", "\u0000").option("compression", "none").text(path)
    files, where = _file_system(spark, path)
    for k, found in enumerate(sorted((f.getPath() for f in files.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())):
        files.rename(found, spark._jvm.org.apache.hadoop.fs.Path(where, f"records-{k:06d}.warc.gz"))


class _File:
    """Reads at any place of a file by its URI."""

    def __init__(self, uri: str):
        if uri.startswith("file:"):
            self.file = open(re.sub("^file:/*", "/", uri), "rb")  # noqa: SIM115  closed by the task's end
            self.at = self._seek
        else:
            from pyarrow import fs

            system, name = fs.FileSystem.from_uri(uri)
            self.file = system.open_input_file(name)
            self.at = lambda place, size: self.file.read_at(size, place)

    def _seek(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)


def _starts_record(at, place: int) -> bool:
    """Does a member that decodes to a WARC header begin here?"""
    try:
        return zlib.decompressobj(31).decompress(at(place, 512), 64).startswith(b"WARC/")
    except zlib.error:
        return False


def _decoded(at, place: int) -> tuple[bytes, int]:
    """The member that begins here, and where it ends."""
    expand, out = zlib.decompressobj(31), []
    while not expand.eof:
        piece = at(place, READ_BYTES if out else 64 << 10)
        if not piece:
            raise EOFError(f"a member is cut off at {place}")
        out.append(expand.decompress(piece))
        place += len(piece)
    return b"".join(out), place - len(expand.unused_data)


def _records_in(at, start: int, end: int):
    """(place, bytes) of the records that start in a range."""
    place = start
    while place < end:
        window = at(place, min(READ_BYTES, end - place) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        if found < 0:
            if len(window) < len(MAGIC):
                return
            place += len(window) - len(MAGIC) + 1
            continue
        place += found
        if place >= end:
            return
        if _starts_record(at, place):
            record, after = _decoded(at, place)
            yield place, record
            place = after
        else:
            place += 1


_PAGE = re.compile(rb"<urn:page:(\w+|-\d+)>")


def _parsed(record: bytes) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    block = block[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields[b"warc-type"].decode()
    names = [m[1] if (m := _PAGE.search(fields.get(f, b""))) else b"null" for f in (b"warc-record-id", b"warc-refers-to")]
    page, refers = (None if x == b"null" else int(x) for x in names)
    stated = fields[b"warc-payload-digest"].decode().rpartition(":")[2]
    if kind == "response":
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if digest != stated:
            raise ValueError(f"record of page {page}: its payload does not match its digest")
    else:
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
        digest, payload = stated, None
    return page, fields[b"warc-target-uri"].decode(), kind, refers, digest, size, payload


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])
_RECORDS_DDL = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, path string, offset long"


def _batched(records, path: str, payloads: bool):
    rows, size = [], 0
    for place, record in records:
        row = _parsed(record)
        rows.append((*row[:6], row[6] if payloads else None, path, place))
        size += len(record)
        if size >= kit.BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of all *.gz files in a folder: page_id, url, record_type, refers_to, payload_digest, payload_bytes,
    payload (null for revisits, or with payloads=False), path, offset.

    A file system that only Spark's readers can open has its files read as wholes, one task for each.
    """
    kit.bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n"), F.min("path").alias("first")).first()

    def ranges(batches):
        for batch in batches:
            for uri, start, end in zip(*(batch[c].to_pylist() for c in ("path", "start", "end")), strict=True):
                yield from _batched(_records_in(_File(uri).at, start, end), uri, payloads)

    def wholes(batches):
        for batch in batches:
            for uri, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                yield from _batched(_records_in(lambda place, size, data=data: data[place : place + size], 0, len(data)), uri, payloads)

    try:
        if total["first"]:
            _File(total["first"])
    except (OSError, ValueError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return files.select("path", "content").mapInArrow(kit.lean(wholes), _RECORDS_DDL)
    table = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    table = table.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end"))
    table = table.repartition(max(1, min(kit.PARTITIONS, -(-total["n"] // split_bytes))), "path", "start")
    return table.mapInArrow(kit.lean(ranges), _RECORDS_DDL)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = kit.shared_folder(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same records by SQL, for the whole table.
OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
