"""WARC archives: chunked payloads, segmented records, revisits; and reading them back.

Archives are written by Spark's text writer: a record is one line, and the
blank lines that end a record are the line separator.  So files are committed,
and compressed, like any other output and lie in whatever store the path names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.llm.common import heavy_join, store

#: Longest block of one record; a longer one is continued in further records.
SEGMENT_BYTES = 8 << 10
#: Length of a chunk of the transfer framing.
CHUNK_BYTES = 2 << 10
#: Payload bytes per archive.
ARCHIVE_BYTES = 64 << 20
#: Payloads of at least so many bytes are stored once and revisited.
MIN_REVISIT_BYTES = 0

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        at = line + 2
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    """The decoded body of an HTTP response."""
    head, _, body = block.partition(END)
    fields = [line.lower().replace(b" ", b"") for line in head.split(b"\r\n")[1:]]
    return dechunked(body) if b"transfer-encoding:chunked" in fields else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}".encode() for name, value in fields if value is not None]
    return b"\r\n".join([VERSION, *lines, b"Content-Length: %d" % len(block)]) + END + block


def page_records(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES
) -> list[bytes]:
    """The records of a page: a response and its continuations, or a revisit."""
    name = f"<urn:uuid:{uuid4()}>"
    uri = None if url is None else url.translate(_ONE_LINE)
    shared: list[tuple[str, object]] = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-Id", page_id)]
    digest = ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        target = ("X-Refers-To-Page-Id", refers_to)
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *shared, digest, profile, target], b"")]
    block = HTTP + chunked(payload)
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    head = [("WARC-Type", "response"), ("WARC-Record-ID", name), *shared, digest]
    if len(cuts) == 1:
        return [_record(head, block)]
    records = [_record([*head, ("WARC-Segment-Number", 1)], cuts[0])]
    for number, part in enumerate(cuts[1:], 2):
        total = len(block) if number == len(cuts) else None
        fields = [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid4()}>"), *shared,
            ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total),
        ]
        records.append(_record(fields, part))
    return records


_ONE_LINE = {10: "%0A", 13: "%0D"}


def revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to): pages whose payload a page of smaller id holds, and that page.

    Only ids and digests are shuffled.  Pages without an id are responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    named = pages.select(F.col(id_col).alias("page_id"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("_bytes"))
    named = store(named.filter((F.col("_bytes") >= min_bytes) & F.col("page_id").isNotNull()).drop("_bytes"), "warc-digests")
    firsts = named.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    found = heavy_join(named, store(firsts, "warc-firsts"), "digest", "_n", named.count())
    return found.filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


#: Rows of a batch taken into Python at once, and bytes or rows handed back at once.
_TAKEN_ROWS, _HELD_BYTES, _HELD_ROWS = 256, 4 << 20, 10_000


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of the batches, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _TAKEN_ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, _TAKEN_ROWS).columns))


def _in_batches(rows: Iterator[tuple[tuple, int]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of the rows, each given with its bytes; a batch ends when it holds enough of either."""
    some, held = [], 0
    for row, size in rows:
        some.append(row)
        held += size
        if held > _HELD_BYTES or len(some) == _HELD_ROWS:
            yield _as_batch(some, names, kinds)
            some, held = [], 0
    if some:
        yield _as_batch(some, names, kinds)


def _as_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def write_archives(
    pages: DataFrame, id_col: str, url_col: str, payload_col: str, path: str,
    min_bytes: int = MIN_REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write a record, or several, for each page to archives below ``path``.

    Null payloads are empty.  Of equal payloads of at least ``min_bytes``
    bytes, the page with the smallest id (all its rows, if it is repeated)
    holds it and the others revisit it.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    total = pages.agg(F.sum(F.octet_length(payload))).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    elsewhere = store(revisits(pages, id_col, payload_col, min_bytes), "warc-revisits")
    # pages without an id match nothing; a key of the row keeps them apart, also equal ones
    key = F.coalesce(F.col("page_id"), F.xxhash64("digest", F.monotonically_increasing_id()))
    dealt = rows.withColumn("_key", key).repartition(archives, "_key")
    known = elsewhere.withColumn("_key", F.col("page_id")).drop("page_id").repartition(archives, "_key")
    joined = dealt.join(known, ["_key", "digest"], "left").select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (r for row in _rows(batches) for r in page_records(*row, segment_bytes=segment_bytes))
        return _in_batches((((r,), len(r)) for r in records), ["record"], [pa.binary()])

    records = joined.mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.options(lineSep=END.decode(), compression="gzip").text(path)


def gunzipped(data: bytes) -> bytes:
    """The archive, compressed or not; its size is bounded by what a task wrote."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, by their lengths."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        start = end + len(END)
        stop = start + int(fields["content-length"])
        if data[stop : stop + len(END)] != END:
            raise ValueError("a record is cut short")
        yield fields, data[start:stop]
        at = stop + len(END)


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def _checked(payload: bytes, digest: str | None) -> bytes:
    if digest is not None and digest != payload_digest(payload):
        raise ValueError("a payload does not have its digest")
    return payload


_PAGE = "page_id bigint, url string, record_type string, payload_digest string, refers_to bigint, payload binary, payload_bytes bigint"
#: A record as it was read: a page, or with a ``number`` a segment whose block is in ``payload``.
_RECORD = f"origin string, number bigint, total bigint, {_PAGE}"


def _scan(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """Every record of the archives in one pass; whole ones are decoded and verified, without ``payloads`` only measured."""

    def read(content: bytes) -> Iterator[tuple[tuple, int]]:
        for fields, block in records_of(gunzipped(content)):
            number = _number(fields, "warc-segment-number")
            kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            shared = (_number(fields, "x-page-id"), fields.get("warc-target-uri"), kind, digest, _number(fields, "x-refers-to-page-id"))
            if number is not None:
                origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                yield (origin, number, _number(fields, "warc-segment-total-length"), *shared, block, None), len(block)
            else:
                payload = _checked(http_payload(block), digest) if kind == "response" else None
                size = None if payload is None else len(payload)
                yield (None, None, None, *shared, payload if payloads else None, size), len(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _in_batches(read(content.as_py()), _names(_RECORD), _ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, _RECORD)


_ARROW = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def assembled(origin: str, parts: list[tuple], payloads: bool) -> tuple:
    """The page of one origin from its segments, rows of a record in the order of their numbers."""
    _, _, _, page, url, _, digest, _, _, _ = parts[0]
    block = b"".join(p[8] for p in parts)
    totals = [p[2] for p in parts if p[2] is not None]
    if [p[1] for p in parts] != list(range(1, len(parts) + 1)) or totals != [len(block)]:
        raise ValueError(f"segments of a record are missing: {origin}")
    payload = _checked(http_payload(block), digest)
    return page, url, "response", digest, None, payload if payloads else None, len(payload)


def reassemble(parts: DataFrame, payloads: bool = True) -> DataFrame:
    """Pages from their segments: by origin, in the order of their numbers, verified, decoded.

    A task takes its segments as one sorted stream, so it holds those of one
    page, and the pages come out many to a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groupby(_rows(batches), itemgetter(0))
        pages = (assembled(origin, list(group), payloads) for origin, group in groups)
        return _in_batches(((p, len(p[5] or b"")) for p in pages), _names(_PAGE), _ARROW[3:])

    dealt = parts.select(*_names(_RECORD)).repartition("origin").sortWithinPartitions("origin", "number")
    return dealt.mapInArrow(run, _PAGE)


def _pages(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """One row per page; the archives are read once, into a stored table of records."""
    records = store(_scan(spark, path, payloads), "warc-records")
    whole = records.filter("number IS NULL").drop("origin", "number", "total")
    return whole.unionByName(reassemble(records.filter("number IS NOT NULL"), payloads))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: id, url, record type, payload digest, referred page, payload (null for revisits) and its length.

    Every payload read is held against its digest, every segmented block
    against its total length; an archive that fails ends the job.
    """
    return _pages(spark, path, payloads=True)


def page_digests(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page; revisits have
    the length of the payload they refer to."""
    read = _pages(spark, path, payloads=False).drop("payload", "url")
    read = store(read, "warc-pages")
    pages = read.filter("record_type = 'response'")
    again = read.filter("record_type = 'revisit'").drop("payload_bytes")
    held = pages.select("payload_digest", "payload_bytes").distinct()
    lengths = again.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("_n")).join(held, "payload_digest")
    found = heavy_join(again, store(lengths, "warc-lengths"), "payload_digest", "_n", again.count())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pages.select(*names).unionByName(found.select(*names))
