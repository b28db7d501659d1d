"""WARC archives: records written in segments with chunked HTTP bodies; segment reassembly, length checks and decoding."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

#: Bytes of a record's block before it goes on in a continuation record; records in a file; bytes of an HTTP chunk.
#: A file thus holds at most SEGMENT x RECORDS bytes of blocks, so one can be read as a whole.
SEGMENT, RECORDS, CHUNK = 64 << 10, 512, 16 << 10
#: Payloads from this size on are kept once; equal ones become revisits.
LEAST_SHARED = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "record_id string, origin_id string, page_id long, url string, record_type string, refers_to long, segment int, total long, header_digest string, block binary, payload binary, payload_bytes long, payload_digest string, error string"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The content of a body in chunked transfer coding; extensions and trailers are skipped. ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        size = int(body[at:end].partition(b";")[0].strip() or b"x", 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another length")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response, decoded from chunked framing if its head says so."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP head")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head) else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}" for k, v in fields if v is not None]
    return ("\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The record of a page, and its continuations."""
    own = f"<urn:uuid:{uuid.uuid4()}>"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    fields = [("WARC-Record-ID", own), ("WARC-Target-URI", url), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", _PROFILE), ("WARC-Refers-To-Page-ID", refers_to)], head + b"\r\n")
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *fields], block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for n, part in enumerate(parts, 1):
        number = [("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)]
        if n == 1:
            yield _record([("WARC-Type", "response"), *fields, *number], part)
        else:
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", own), *number], part)


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, per_file: int = RECORDS) -> None:
    """Write pages(page_id, url, html) as gzipped WARC files under path, one record (or more segments) per row.

    Equal payloads of at least LEAST_SHARED bytes are stored once, with the smallest page_id; the others refer to it.
    Files are written by Spark's committed writer, so a lost task leaves no half file: a record is a line of text whose
    separator is the WARC record's closing two line ends. A null html is an empty payload; null ids and urls have no header.
    Rows that repeat a whole row of the smallest page_id are responses like it; an empty table gives no records; other
    columns are not read. A very long payload is held by one task and goes out in segments.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    # Written, so that both sides of the join are plain and a digest of very many pages can be split.
    shared = written(pages.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc_shared")
    again = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    rows = pages.join(shared, "digest", "left").select("page_id", "url", "digest", again.alias("refers_to"), F.when(again.isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                own = list(records(r["page_id"], r["url"], r["payload"] or b"", r["digest"], r["refers_to"], segment))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], names=["value"])

    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a file in pieces: all members of a gzip file, or the data as they are. No piece is larger than 8 x step."""
    view, at, rest, member = memoryview(data), 0, b"", None
    while rest or at < len(view):
        while len(rest) < 2 and at < len(view):
            rest, at = rest + bytes(view[at : at + step]), at + step
        if member is None:
            if rest[:2] != b"\x1f\x8b":
                yield rest
                rest = b""
                continue
            member = zlib.decompressobj(31)
        yield member.decompress(rest, 8 * step)
        rest = member.unconsumed_tail
        if member.eof:
            rest, member = member.unused_data, None
    if member is not None:
        yield member.flush()
        if not member.eof:
            raise ValueError("the gzip file ends early")


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a file that comes in pieces; one record is in memory at a time. ValueError for broken framing."""
    held, done = bytearray(), False

    def until(enough: Callable[[], bool]) -> bool:
        nonlocal done
        while not enough():
            piece = next(pieces, None)
            done = piece is None
            if done:
                return False
            held.extend(piece)
        return True

    number = 0
    while True:
        while until(lambda: len(held) >= 2) and held.startswith(b"\r\n"):
            del held[:2]
        if not held:
            return
        seen = 0

        def headed() -> bool:  # looks at each byte once
            nonlocal seen
            found = held.find(b"\r\n\r\n", max(0, seen - 3)) >= 0
            seen = len(held) if not found else seen
            return found or (len(held) >= 7 and not held.startswith(b"WARC/1."))

        if not until(headed) or not held.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record after {number} records")
        end = held.find(b"\r\n\r\n")
        pairs = (line.partition(":") for line in held[:end].decode().split("\r\n")[1:])
        headers = {k.strip().lower(): v.strip() for k, _, v in pairs}
        start, size = end + 4, int(headers["content-length"])
        if not until(lambda: len(held) >= start + size):  # noqa: B023
            raise ValueError(f"record {number} ends early")
        yield headers, bytes(held[start : start + size])
        del held[: start + size]
        number += 1


def _done(block: bytes, kind: str, keep: bool) -> tuple[bytes | None, int | None, str | None, str | None]:
    """(payload, bytes, digest, error) of a whole block."""
    try:
        payload = b"" if kind == "revisit" else http_payload(block)
    except ValueError as e:
        return None, None, None, str(e)
    return payload if keep else None, len(payload), hashlib.sha256(payload).hexdigest(), None


_SCHEMA = pa.schema([("record_id", pa.string()), ("origin_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("segment", pa.int32()), ("total", pa.int64()), ("header_digest", pa.string()), ("block", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())])


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """(record_id, page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, error), one row per record with its continuations.

    Files may be gzipped or not. Segments are grouped by their origin, ordered by number, and joined if they are
    complete and as long as the last one says; else, or with broken HTTP framing, payload and its figures are null and
    error tells why. A file is inflated and read record by record: of a large one only the compressed bytes and one
    record are in memory. A revisit has the payload, size and digest of the response that it refers to. Only segments of
    divided records are shuffled, a record at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: None if v is None else int(v)
        table_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for h, block in parsed(inflated(data.as_py())):
                    size += len(block)
                    if size > 8 << 20 and rows:
                        yield table_of(rows)
                        rows, size = [], len(block)
                    kind, segment, own = h["warc-type"], number(h.get("warc-segment-number")), h["warc-record-id"]
                    done = (None,) * 4 if segment else _done(block, kind, keep_payload)
                    rows.append((own, h.get("warc-segment-origin-id", own), number(h.get("warc-page-id")), h.get("warc-target-uri"), kind, number(h.get("warc-refers-to-page-id")), segment, number(h.get("warc-segment-total-length")), h.get("warc-payload-digest", ":").partition(":")[2], block if segment else None, *done))
                if rows:
                    yield table_of(rows)

    def joined(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
        head = rows[0]
        block = b"".join(r["block"] for r in rows)
        if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)):
            done = (None, None, None, "a segment is missing or twice there")
        elif rows[-1]["total"] != len(block):
            done = (None, None, None, f"{len(block)} bytes instead of {rows[-1]['total']}")
        else:
            done = _done(block, head["record_type"], keep_payload)
        own = head | dict(zip(("payload", "payload_bytes", "payload_digest", "error"), done, strict=True)) | {"block": None}
        return pa.Table.from_pylist([own], _SCHEMA)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path)
    table = written(files.select("content").mapInArrow(run, PARSED), "warc_records")
    whole = table.where("segment is null").unionByName(table.where("segment is not null").groupBy("origin_id").applyInArrow(joined, PARSED))
    names = ["record_id", "page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "error"]
    plain = whole.where("record_type != 'revisit'").select(*names)
    wanted = table.where("record_type = 'revisit'").select("refers_to", "header_digest").distinct()
    origin = plain.where("page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("header_digest"), "payload", "payload_bytes", "payload_digest", "error")
    origin = written(origin.join(wanted, ["refers_to", "header_digest"], "left_semi").dropDuplicates(["refers_to", "header_digest"]), "warc_origins")
    revisits = whole.where("record_type = 'revisit'").drop("payload", "payload_bytes", "payload_digest", "error").join(origin, ["refers_to", "header_digest"], "left")
    lost = F.when(F.col("payload_digest").isNull() & F.col("error").isNull(), F.lit("its response is missing")).otherwise(F.col("error"))
    return plain.unionByName(revisits.withColumn("error", lost).select(*names))


def round_trip(pages: DataFrame, keep_payload: bool = False) -> DataFrame:
    """read_archives() of what write_archives() makes of the pages."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, keep_payload)
