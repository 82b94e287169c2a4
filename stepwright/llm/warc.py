"""Operator 1. WARC segment reassembly.

Records are rows: record_id, warc_type (response, continuation, ...),
origin_id (WARC-Segment-Origin-ID; null in a first segment), segment_number,
total_length (WARC-Segment-Total-Length, in the last segment) and block (the
payload bytes, HTTP head and body), and damage (why a record could not be read,
else null). Segments are grouped by origin, put in the
order of their numbers, checked for gaps and for the total length, and joined;
then the HTTP head is parted off and chunked transfer framing is decoded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "record_id string, warc_type string, target_uri string, origin_id string, segment_number int, total_length long, block binary, damage string"
#: Types of records that hold what a server sent; requests, metadata, warcinfo and others are not put together.
PAYLOADS = ("response", "resource", "continuation")
#: Bytes of a file that are read at once, and bytes in which a record's head must end.
READ_BYTES = 1 << 20
HEAD_BYTES = 1 << 16
REASSEMBLED = "record_id string, target_uri string, segments int, length long, status string, http_status int, chunked boolean, body binary"
_CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n")


def decode_chunked(data: bytes) -> tuple[bytes, bool]:
    """(body, whole): chunks are joined, extensions and trailers dropped; whole is false if the framing breaks off or is wrong."""
    parts, at = [], 0
    while True:
        m = _CHUNK.match(data, at)
        if not m:
            return b"".join(parts), False
        size, at = int(m[1], 16), m.end()
        if size == 0:
            return b"".join(parts), data.startswith((b"\r\n", b"\n"), at) or b"\r\n\r\n" in data[at:] or at == len(data)
        parts.append(data[at : at + size])
        if at + size > len(data):
            return b"".join(parts), False
        at += size
        if data.startswith(b"\r\n", at):
            at += 2
        elif data.startswith(b"\n", at):
            at += 1
        else:
            return b"".join(parts), False


def decode_response(block: bytes) -> tuple[int | None, bool, bytes, bool]:
    """(HTTP status, chunked, body, whole) of a payload; one without an HTTP head is all body."""
    if not block.startswith(b"HTTP/"):
        return None, False, block, True
    end = block.find(b"\r\n\r\n")
    skip = 4
    if end < 0:
        end, skip = block.find(b"\n\n"), 2
    if end < 0:
        return None, False, b"", False
    head = block[:end].split(b"\n")
    code = re.match(rb"HTTP/\S+ +(\d{3})", head[0])
    chunked = any(k.strip().lower() == b"transfer-encoding" and v.strip().lower().rpartition(b",")[2].strip() == b"chunked" for k, _, v in (h.partition(b":") for h in head[1:]))
    body, whole = block[end + skip :], True
    if chunked:
        body, whole = decode_chunked(body)
    return int(code[1]) if code else None, chunked, body, whole


def reassemble(records: DataFrame) -> DataFrame:
    """One row for each origin: record_id, target_uri, segments, length, status, http_status, chunked, body.

    status is ok; missing_segment (numbers don't run from 1 on without a gap, or there is no first segment);
    length_mismatch (a total length is given and differs, or several differ); damaged (a segment is marked so); or
    bad_framing. body is null unless status is ok. Only records of PAYLOADS and those without a type count. A record without a segment number is a whole record of its own. A segment that is repeated with
    equal bytes counts once; with other bytes the one whose bytes sort first counts. A null block has no bytes.
    Records with neither record_id nor origin_id can't be grouped and are left out. Empty tables give no rows, and
    columns other than those of RECORDS are not looked at; damage may be missing.
    """
    if "damage" not in records.columns:
        records = records.withColumn("damage", F.lit(None).cast("string"))
    records = records.where(F.col("warc_type").isNull() | F.lower("warc_type").isin(*PAYLOADS))
    origin = F.coalesce("origin_id", "record_id")
    number = F.coalesce("segment_number", F.lit(1))
    block = F.coalesce("block", F.lit(b""))
    one = records.select(origin.alias("origin"), number.alias("number"), "target_uri", "total_length", block.alias("block"), F.col("damage").isNotNull().alias("bad")).where("origin is not null")
    grouped = one.groupBy("origin").agg(F.max(F.when(F.col("number") == 1, F.col("target_uri"))).alias("uri"), F.max("total_length").alias("most"), F.min("total_length").alias("least"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("segments"), F.max("bad").alias("bad"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for origin_id, uri, most, least, segments, bad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts: dict[int, bytes] = {}
                for s in segments:
                    parts.setdefault(s["number"], s["block"])
                data = b"".join(parts[k] for k in sorted(parts))
                code, chunked, body, status = None, False, None, "ok"
                if sorted(parts) != list(range(1, len(parts) + 1)):
                    status = "missing_segment"
                elif bad:
                    status = "damaged"
                elif most is not None and (most != len(data) or least != most):
                    status = "length_mismatch"
                else:
                    code, chunked, body, whole = decode_response(data)
                    if not whole:
                        status, body = "bad_framing", None
                rows.append((origin_id, uri, len(parts), len(data), status, code, chunked, body))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary())
            names = ["record_id", "target_uri", "segments", "length", "status", "http_status", "chunked", "body"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return grouped.mapInArrow(join, REASSEMBLED)


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes | None]:
    """The chunks with gzip members unpacked, chunk by chunk; None where a member is damaged or breaks off, after which the next one is sought."""
    magic = b"\x1f\x8b\x08"
    head, rest = b"", iter(chunks)
    for c in rest:
        head += c
        if len(head) >= 3:
            break
    if not head.startswith(magic):
        if head:
            yield head
        yield from rest
        return
    data, member = head, zlib.decompressobj(31)
    seeking = begun = False
    while True:
        if not data:
            data = next(rest, b"")
            if not data:
                break
        if seeking:
            at = data.find(magic)
            if at < 0:
                more = next(rest, b"")
                data = data[-2:] + more
                if not more:
                    return
                continue
            data, member, seeking = data[at:], zlib.decompressobj(31), False
        try:
            out = member.decompress(data, READ_BYTES)
            left = member.unconsumed_tail
            if out:
                yield out
            begun = not member.eof
            if member.eof:
                left, member = member.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
            data = left
        except zlib.error:
            yield None
            data, seeking, begun = data[1:], True, False
    if not seeking and begun:
        last = member.flush()
        if last:
            yield last
        if not member.eof:
            yield None


def parse_stream(chunks: Iterator[bytes | None]) -> Iterator[tuple]:
    """Records (as RECORDS) of a WARC file's unpacked chunks; None marks damage. One record is held at a time.

    A record that breaks off has its bytes so far and damage truncated; one whose head has no end or no number of
    bytes has damage bad_head, and the next record is sought from there.
    """
    buffer, rest, broken, ended = bytearray(), iter(chunks), False, False

    def fill(n: int) -> bool:
        """Whether the buffer has n bytes, reading on up to damage or the end."""
        nonlocal broken, ended
        while len(buffer) < n and not broken and not ended:
            c = next(rest, b"")
            if c is None:
                broken = True
            elif c == b"":
                ended = True
            else:
                buffer.extend(c)
        return len(buffer) >= n

    while True:
        at = buffer.find(b"WARC/")
        while at < 0 and fill(len(buffer) + 1):
            at = buffer.find(b"WARC/", max(0, len(buffer) - READ_BYTES - 5))
            if at < 0:
                del buffer[:-5]
        if at < 0:
            buffer.clear()
            if broken:
                broken = False
                yield None, None, None, None, None, None, None, "bad_gzip"
                continue
            return
        del buffer[:at]
        end = buffer.find(b"\r\n\r\n")
        while end < 0 and len(buffer) < HEAD_BYTES and fill(len(buffer) + 1):
            end = buffer.find(b"\r\n\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (h.partition(b":") for h in bytes(buffer[: max(end, 0)]).split(b"\r\n")[1:])}
        text = lambda k: head[k].decode("utf-8", "replace").strip("<>") if k in head else None  # noqa: B023, E731
        count = lambda k, most: int(head[k]) if head.get(k, b"").isdigit() and int(head[k]) <= most else None  # noqa: B023, E731
        size = count(b"content-length", 1 << 62)
        names = (text(b"warc-record-id"), text(b"warc-type"), text(b"warc-target-uri"), text(b"warc-segment-origin-id"), count(b"warc-segment-number", (1 << 31) - 1), count(b"warc-segment-total-length", (1 << 63) - 1))
        wrong = any(k in head and count(k, (1 << 31) - 1) is None for k in (b"warc-segment-number",))
        if end < 0 or size is None or wrong:
            yield *names, None, "bad_head"
            del buffer[:5]
            continue
        whole = fill(end + 4 + size)
        block = bytes(buffer[end + 4 : end + 4 + size])
        yield *names, block, None if whole else "truncated"
        del buffer[: end + 4 + size]
        if broken and not whole:
            broken = False


def parse_warc(data: bytes) -> Iterator[tuple]:
    """parse_stream() of a WARC file's bytes; gzip members are unpacked first."""
    return parse_stream(inflated(iter([data])))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS of WARC files (plain, gzip, or a gzip member for each record), one task a file, read as a stream.

    Damage fails no job: see parse_stream() and inflated(). Empty files have no records. Only the files' names come from
    Spark; each task opens its files itself, through the file system that their address names.
    """

    def chunks(name: str) -> Iterator[bytes]:
        system, at = pyarrow.fs.FileSystem.from_uri(name)
        with system.open_input_stream(at, compression=None) as f:
            while data := f.read(READ_BYTES):
                yield data

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string())
        names = ["record_id", "warc_type", "target_uri", "origin_id", "segment_number", "total_length", "block", "damage"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for r in parse_stream(inflated(chunks(name))):
                    rows.append(r)
                    size += len(r[6] or b"")
                    if len(rows) >= 1000 or size >= 8 * READ_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    address = F.regexp_replace("path", "^file:/(?!/)", "file:///")
    return spark.read.format("binaryFile").load(path).select(address.alias("path")).mapInArrow(parse, RECORDS)


SEGMENT_BYTES = 4096
CHUNK_BYTES = 1000


def records_of_pages(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """RECORDS as a crawler would have stored pages: each an HTTP response in chunked framing, cut into segments, last segment first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string())
        names = ["record_id", "warc_type", "target_uri", "origin_id", "segment_number", "total_length", "block", "damage"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = []
                for page, url, html in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns), strict=True):
                    data = (html or "").encode()
                    framed = b"".join(b"%x\r\n%b\r\n" % (len(data[k : k + chunk_bytes]), data[k : k + chunk_bytes]) for k in range(0, len(data), chunk_bytes))
                    whole = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + framed + b"0\r\n\r\n"
                    n = -(-len(whole) // segment_bytes)
                    for k in reversed(range(n)):
                        own = f"urn:page:{page}" if k == 0 else f"urn:page:{page}:{k + 1}"
                        rows.append((own, "response" if k == 0 else "continuation", url, None if k == 0 else f"urn:page:{page}", k + 1, len(whole) if k == n - 1 else None, whole[k * segment_bytes : (k + 1) * segment_bytes], None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return pages.select(F.col("page_id").cast("string"), "url", "html").where("page_id is not null").mapInArrow(cut, RECORDS)
