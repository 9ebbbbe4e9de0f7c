"""WARC archives: write pages as records, reassemble segments, decode payloads.

Writing: a page becomes a response record whose HTTP block is chunked; a block
longer than ``segment_bytes`` is cut into a first record and continuation
records (WARC-Segment-Origin-ID, -Number, -Total-Length).  Pages with equal
payloads of at least ``min_bytes`` bytes get one response (largest page_id);
the others become revisit records that refer to it.  Records are rows of a
text table whose line separator is the record separator, so each output file
is a plain WARC file (gzip), written by Spark's committer.

Reading: files are read whole (bounded: ``records_per_file`` records of
bounded size), cut into records by Content-Length, continuation records are
grouped by origin id, ordered by segment number, checked against the total
length, and the chunked framing is decoded.

Defined results: a null payload is empty; rows with a null page_id are
responses that nobody refers to; rows that repeat a page_id are records of
their own (all rows with the class's largest id are responses); a record
whose segments are not complete comes out as ``damaged`` with a null payload;
null urls become ``urn:page``; an empty table gives an empty archive; other
columns are ignored.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import scratch_dir, table, utf8, written

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 304 Not Modified\r\n\r\n"
#: Rows read from, and bytes gathered for, one exchange with Spark.
SLICE_ROWS, FLUSH_BYTES = 64, 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i:i + size]
        parts += [b"%X\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes | None:
    """Payload of a chunked body; None if the framing is broken."""
    at, out = 0, []
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if end < 0 or size < 0 or len(body) < end + 2 + size:
            return None
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        at = end + 4 + size


def _rows(batches, names: list[str]):
    """Tuples of the named columns; few rows at a time become Python values."""
    for batch in batches:
        columns = [batch.column(name) for name in names]
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield from zip(*(c.slice(start, SLICE_ROWS).to_pylist() for c in columns))


def _batches(rows, schema: pa.Schema):
    """Record batches of about FLUSH_BYTES; the last column is the large one."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") + 200
        if size >= FLUSH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


_RECORD = pa.schema([("record", pa.binary())])


def _record(kind: str, record_id: str, block: bytes, fields: list[tuple[str, object]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), *fields, ("Content-Length", len(block))]
    text = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + text.encode() + b"\r\n" + block


def _writer(segment_bytes: int, chunk_bytes: int, date: str):
    def records(page, url, payload, refers):
        number = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        urn = f"urn:page:{'' if page is None else page}#{number}"
        target = "urn:page" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        common = [("WARC-Date", date), ("WARC-Target-URI", target), ("X-Page-ID", page),
                  ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("X-Payload-Length", len(payload))]
        if refers is not None:
            yield _record("revisit", urn, REVISIT_HEAD, [*common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}>"),
                                                         ("Content-Type", "application/http; msgtype=response")])
            return
        block = HTTP_HEAD + chunked(payload, chunk_bytes)
        common.append(("Content-Type", "application/http; msgtype=response"))
        if len(block) <= segment_bytes:
            yield _record("response", urn, block, common)
            return
        starts = range(0, len(block), segment_bytes)
        for k, start in enumerate(starts, 1):
            part = block[start:start + segment_bytes]
            if k == 1:
                yield _record("response", urn, part, [*common, ("WARC-Segment-Number", 1)])
            else:
                yield _record("continuation", f"{urn}/{k}", part, [
                    ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", f"<{urn}>"), ("WARC-Segment-Number", k),
                    ("WARC-Segment-Total-Length", len(block) if k == len(starts) else None)])

    def run(batches):
        made = (record for row in _rows(batches, ["page_id", "url", "raw", "refers_to"])
                for record in records(row[0], row[1], row[2] or b"", row[3]))
        return _batches(((record,) for record in made), _RECORD)
    return run


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, print, refers_to) of the pages that repeat another page's payload."""
    raw = F.coalesce(utf8("html"), F.lit(b""))
    own = written(pages.where(F.col("page_id").isNotNull() & (F.length(raw) >= min_bytes))
                  .select(F.col("page_id").cast("long").alias("page_id"), F.sha2(raw, 256).alias("print")), "warc-prints")
    classes = written(own.groupBy("print").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
                      .where("n > 1").select("print", "refers_to"), "warc-classes")
    return own.join(classes, "print").where("page_id <> refers_to").select("page_id", "print", "refers_to").distinct()


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = 1 << 16, chunk_bytes: int = 1 << 13,
                  records_per_file: int = 200, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write ``pages`` (page_id, url, html) as WARC files into the folder ``path``."""
    raw = F.coalesce(utf8("html"), F.lit(b""))
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("raw"))
            .withColumn("print", F.sha2("raw", 256)).join(revisits(pages, min_bytes), ["page_id", "print"], "left"))
    (rows.select("page_id", "url", "raw", "refers_to").mapInArrow(_writer(segment_bytes, chunk_bytes, date), "record binary")
     .select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))
    return path


def split_records(data: bytes):
    """(headers, block) of each record of an archive file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


_HEAD = [("kind", pa.string()), ("page_id", pa.int64()), ("target", pa.string()), ("digest", pa.string()), ("length", pa.int64()),
         ("refers_to", pa.int64())]
_SEGMENT = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), *_HEAD, ("block", pa.binary())])
_SEGMENT_SQL = ("origin string, segment int, total long, kind string, page_id long, target string, digest string, length long, "
                "refers_to long, block binary")
_PAGE = pa.schema([("page_id", pa.int64()), ("target", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_PAGE_SQL = ("page_id long, target string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
             "payload binary")


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _head(f: dict[str, str], kind: str | None) -> tuple:
    """The fields of _HEAD from a record's headers."""
    refers = f.get("WARC-Refers-To")
    return (kind, _number(f.get("X-Page-ID")), f.get("WARC-Target-URI"), f.get("WARC-Payload-Digest"), _number(f.get("X-Payload-Length")),
            _number(refers and refers.rpartition(":")[2].rstrip(">")))


def _archive_records(batches):
    for batch in batches:
        for content in batch.column("content"):
            data = content.as_py()
            yield from split_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)


def _page(head: tuple, block: bytes, whole: bool) -> tuple:
    """A row of _PAGE from a reassembled record."""
    kind, page, target, told, size, refers = head
    told, payload = (told or "").removeprefix("sha1:"), None
    if kind != "revisit":
        if whole and kind == "response":
            http, _, body = block.partition(b"\r\n\r\n")
            payload = dechunk(body) if b"transfer-encoding: chunked" in http.lower() else body
        if payload is None or digest(payload) != told:
            kind, payload, size = "damaged", None, None
        else:
            size = len(payload)
    return page, target, size, told, kind, refers, payload


def _unsegmented(batches):
    return _batches((_page(_head(f, f["WARC-Type"]), block, True) for f, block in _archive_records(batches)
                     if "WARC-Segment-Number" not in f), _PAGE)


def _segments(batches):
    def rows():
        for f, block in _archive_records(batches):
            if "WARC-Segment-Number" in f:
                more = f["WARC-Type"] == "continuation"
                yield (f["WARC-Segment-Origin-ID" if more else "WARC-Record-ID"], int(f["WARC-Segment-Number"]),
                       _number(f.get("WARC-Segment-Total-Length")), *_head(f, None if more else f["WARC-Type"]), block)
    return _batches(rows(), _SEGMENT)


def _reassembled(batches):
    def rows():
        for batch in batches:
            for i in range(batch.num_rows):  # one record's segments at a time
                total, *head, parts = (column[i].as_py() for column in batch.columns)
                parts.sort(key=lambda p: p["segment"])
                block = b"".join(p["block"] for p in parts)
                whole = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and len(block) == total
                yield _page(tuple(head), block, whole)
    return _batches(rows(), _PAGE)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Reassembled records: page_id, target, payload_bytes, payload_digest, record_type, refers_to, payload.

    The files are read twice, once for unsegmented records, which are decoded on the spot, and once for segments: only
    these are shuffled, and one record's segments meet in one row."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")
    heads = [F.max(c).alias(c) for c in ("total", *[name for name, _ in _HEAD])]
    joined = (files.mapInArrow(_segments, _SEGMENT_SQL).groupBy("origin")
              .agg(*heads, F.collect_list(F.struct("segment", "block")).alias("parts")).drop("origin"))
    return files.mapInArrow(_unsegmented, _PAGE_SQL).unionByName(joined.mapInArrow(_reassembled, _PAGE_SQL))


def op1_warc(spark, sf_dir):
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex[:8]}"
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
