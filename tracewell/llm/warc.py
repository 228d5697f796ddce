"""WARC archives: writing pages as records, and reading records back with their segments reassembled.

Written by Spark's text sink, a record per row, records separated by the two line ends the format asks for; its
commit protocol makes a lost executor harmless. Payloads travel in chunked transfer framing; a block longer than
``SEGMENT_BYTES`` is cut into a first record and continuation records. Reading groups continuation records by the
identifier of their origin, orders them by segment number, verifies the total length, and undoes the framing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 8_192
RECORD_END = "\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
NO_PAGE = "none"

# ---- writing


def framed(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        chunk = payload[at : at + size]
        parts.append(b"%x\r\n%b\r\n" % (len(chunk), chunk))
    return b"".join(parts) + b"0\r\n\r\n"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:page:{NO_PAGE if page is None else page}:{digest}>"


def page_records(page: int | None, url: str | None, payload: bytes, digest: str, original: int | None, revisit: bool,
                 date: str, segment: int) -> list[bytes]:
    """The records of one page, without what ends them."""
    uri = "".join((url or "").split()) or None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page, digest)),
        ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(original, digest)), ("Content-Length", 0),
        ]
        return [_head(fields)]
    block = HTTP_HEAD + framed(payload)
    fields.append(("Content-Type", "application/http;msgtype=response"))
    if len(block) <= segment:
        return [_head([*fields, ("Content-Length", len(block))]) + block]
    records = []
    for number, at in enumerate(range(0, len(block), segment), 1):
        part = block[at : at + segment]
        if number > 1:
            fields = [
                ("WARC-Type", "continuation"), ("WARC-Record-ID", _record_id(page, digest)[:-1] + f":{number}>"),
                ("WARC-Date", date), ("WARC-Segment-Origin-ID", _record_id(page, digest)),
            ]
            if at + segment >= len(block):
                fields.append(("WARC-Segment-Total-Length", len(block)))
        records.append(_head([*fields, ("WARC-Segment-Number", number), ("Content-Length", len(part))]) + part)
    return records


def _records(date: str, segment: int):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, html, sha1, original, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                out += page_records(page, url, html or b"", digest, original, revisit, date, segment)
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return records


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z",
                   segment: int = SEGMENT_BYTES) -> None:
    """Writes ``pages(page_id, url, html)`` as gzipped archives below ``path``.

    Of pages with equal payloads of at least ``least`` bytes, that with the smallest page_id is a response record (so
    is each repetition of that row) and the others revisit it; all others are responses. Null html is empty."""
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"),
        F.sha1(F.coalesce("html", F.lit(""))).alias("sha1"))
    firsts = rows.groupBy("sha1").agg(F.min("page_id").alias("original")).withColumnRenamed("sha1", "of")
    # one plan at every size; a payload of very many pages is split by the skew join
    told = rows.hint("merge").join(firsts, F.col("sha1") == F.col("of"))
    revisit = (F.octet_length("html") >= least) & ~F.col("page_id").eqNullSafe(F.col("original"))
    told = told.select(
        "page_id", "url", F.when(revisit, F.lit(None)).otherwise(F.col("html")).alias("html"), "sha1", "original",
        revisit.alias("revisit"))
    records = told.mapInArrow(_records(date, segment), "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE).text(path)


# ---- reading


def parse_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an opened archive."""
    while True:
        line = file.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            continue
        fields = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields.get("content-length", 0))
        block = file.read(length)
        if len(block) != length:
            raise ValueError(f"record {fields.get('warc-record-id')} ends early")
        yield fields, block


def unframed(body: bytes) -> bytes:
    """The payload of chunked transfer framing; raises where the framing is broken."""
    parts, at = [], 0
    while True:
        line_end = body.index(b"\r\n", at)
        size = int(body[at:line_end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        start = line_end + 2
        if body[start + size : start + size + 2] != b"\r\n":
            raise ValueError("a chunk is not ended")
        parts.append(body[start : start + size])
        at = start + size + 2


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(
        line.lower().startswith(b"transfer-encoding:") and b"chunked" in line.lower() for line in head.split(b"\r\n"))
    return unframed(body) if chunked else body


def reassembled(segments: list[dict]) -> tuple[bytes | None, str | None]:
    """The whole block, or what is wrong. Segments that repeat are used once."""
    by_number = {s["number"]: s for s in segments}
    totals = {s["total"] for s in segments if s["total"] is not None}
    if sorted(by_number) != list(range(1, len(by_number) + 1)) or len(totals) != 1:
        return None, "segments are missing"
    block = b"".join(by_number[n]["block"] for n in sorted(by_number))
    return (block, None) if len(block) == totals.pop() else (None, "the total length differs")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _finish(row: dict, block: bytes | None, error: str | None) -> dict:
    try:
        payload = None if block is None else http_payload(block)
    except ValueError as broken:
        payload, error = None, str(broken)
    if payload is not None:
        row |= {"payload": payload, "payload_bytes": len(payload)}
        found = _digest(payload)
        if row["payload_digest"] not in (None, found):
            error = "the payload's digest differs"
        row["payload_digest"] = found
    return row | {"error": error}


RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()),
    ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string()),
])
SEGMENT = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
RECORD_SQL = ("record_id string, record_type string, uri string, refers_to string, payload binary, payload_bytes long, "
              "payload_digest string, error string")


def _parse(payloads: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*RECORD, *SEGMENT])
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                file = io.BufferedReader(pa.BufferReader(raw)) if raw[:2].to_pybytes() != b"\x1f\x8b" else gzip.GzipFile(
                    fileobj=pa.BufferReader(raw))
                out = []
                for fields, block in parse_records(file):
                    kind = fields.get("warc-type")
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    row = {"record_id": fields.get("warc-record-id"), "record_type": kind, "uri": fields.get("warc-target-uri"),
                           "refers_to": fields.get("warc-refers-to"), "payload_digest": digest}
                    number = fields.get("warc-segment-number")
                    if number is not None:
                        total = fields.get("warc-segment-total-length")
                        row |= {"origin": fields.get("warc-segment-origin-id") or row["record_id"], "number": int(number),
                                "total": None if total is None else int(total), "block": block}
                    elif kind == "response":
                        row = _finish(row, block, None)
                        if not payloads:
                            row.pop("payload", None)
                    out.append(row)
                    if len(out) >= 512:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    return parse


def _join_segments(payloads: bool):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, segments in zip(*(c.to_pylist() for c in batch.columns)):
                row = row or {"record_id": segments[0]["origin"], "record_type": None, "payload_digest": None}
                block, error = reassembled(segments)
                done = _finish(row, block, error)
                if not payloads:
                    done.pop("payload", None)
                # a record written n times comes back n times
                out += [done] * max(1, sum(s["times"] for s in segments if s["number"] == 1))
            yield pa.RecordBatch.from_pylist(out, RECORD)

    return join


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``(record_id, record_type, uri, refers_to, payload, payload_bytes, payload_digest, error)`` of the response and
    revisit records below ``path``, segments reassembled. ``error`` says why a payload could not be made whole; a
    revisit has none of its own. An archive is read as one row, so it must fit in one (writers cut them)."""
    scratch = Scratch(spark, "warc-records")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parsed = scratch.keep(files.mapInArrow(
        _parse(payloads), f"{RECORD_SQL}, origin string, number int, total long, block binary"), "parsed")
    names = [f.name for f in RECORD]
    whole = parsed.where("origin IS NULL AND record_type IN ('response', 'revisit')").select(*names)
    # a segment that is written again and again is one row with a count
    once = parsed.where("origin IS NOT NULL").groupBy("origin", "number", "total", "block").agg(
        F.count("*").alias("times"),
        F.max(F.when(F.col("number") == 1, F.struct("record_id", "record_type", "uri", "refers_to", "payload_digest"))).alias("head"))
    segments = once.groupBy("origin").agg(
        F.max("head").alias("head"), F.collect_list(F.struct("origin", "number", "total", "block", "times")).alias("segments"))
    return whole.unionByName(segments.select("head", "segments").mapInArrow(_join_segments(payloads), RECORD_SQL))


def page_of(record_id: str) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(\d+|-\d+):", 1).try_cast("long")


def pages_read(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``; a revisit's payload is that of the record
    it refers to."""
    responses = records.where("record_type = 'response'")
    revisits = records.where("record_type = 'revisit'").select("record_id", "refers_to", "payload_digest")
    sizes = responses.groupBy(F.col("record_id").alias("of")).agg(F.max("payload_bytes").alias("payload_bytes"))
    told = revisits.hint("merge").join(sizes, F.col("refers_to") == F.col("of"), "left")
    return responses.select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(told.select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"),
        page_of("refers_to").alias("refers_to")))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder, reads them back and gives ``pages_read`` of them. Repeated
    rows are records of their own; an empty table gives no rows; a null page_id comes back null."""
    spark = pages.sparkSession
    path = Scratch(spark, "warc").path("archives")
    write_archives(pages, path, least)
    return pages_read(read_archives(spark, path, payloads=False))
