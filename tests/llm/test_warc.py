import base64
import hashlib
import random

import pyarrow as pa
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from mailrisk.llm import warc
from mailrisk.llm.queries import ORACLES, QUERIES
from mailrisk.session import scratch_path

_SCHEMA = "page_id bigint, url string, html string"


def _expected(rows, least=0):
    out, firsts = [], {}
    for page_id, _, html in rows:
        if page_id is not None:
            firsts[html or ""] = min(firsts.get(html or "", page_id), page_id)
    for page_id, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = firsts.get(html or "", page_id)
        again = page_id is not None and page_id != first and len(data) >= least
        out.append((page_id, len(data), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def _read(spark, rows, **how):
    path = scratch_path(spark, "archives")
    warc.write_archives(spark.createDataFrame(rows, _SCHEMA).repartition(3), "page_id", "url", "html", path, **how)
    return path, sorted((tuple(r) for r in warc.page_digests(spark, path).collect()), key=repr)


def test_query_equals_sql(spark, sf_dir):
    got = QUERIES["op4_warc"](spark, sf_dir).toArrow()
    assert difference(got, connect(sf_dir).sql(ORACLES["op4_warc"]).to_arrow_table()) is None


def test_framing_round_trips():
    rnd = random.Random(1)
    for n in (0, 1, 15, 16, 17, 100_000):
        data = rnd.randbytes(n)
        for size in (1, 16, 64 << 10) if n < 1000 else (16, 64 << 10):
            assert warc.dechunked(warc.chunked(data, size)) == data
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: z\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"9\r\nabc\r\n0\r\n\r\n")


NASTY = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n0\r\n\r\n"


def test_pages_of_every_kind(spark):
    rows = [
        (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "u", ""), (5, "a\r\nb: c", NASTY),
        (6, "x", "é" * 5000), (7, "x", "é" * 5000), (8, "x", "long " * 2000), (None, "n", "<p>same</p>"), (None, "n", None),
        (9, "same row", "twice"), (9, "same row", "twice"), (10, "y", "twice"),
    ]
    _, got = _read(spark, rows)
    assert got == _expected(rows)
    path, got = _read(spark, rows, segment_bytes=700, archive_bytes=6000)
    assert got == _expected(rows)
    assert len(spark.read.format("binaryFile").load(path).collect()) > 2
    assert warc._scan(spark, path, payloads=False).filter("number IS NOT NULL").select("origin").distinct().count() >= 2
    payloads = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, path).collect() if r["payload"] is not None}
    assert payloads[5] == NASTY.encode() and payloads[8] == b"long " * 2000
    _, got = _read(spark, rows, min_bytes=6)
    assert got == _expected(rows, 6)


def test_no_pages(spark):
    path = scratch_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([], _SCHEMA), "page_id", "url", "html", path)
    assert warc.page_digests(spark, path).count() == 0


def test_a_missing_segment_is_noticed(spark):
    rows = [(1, "u", "x" * 5000)]
    path, _ = _read(spark, rows, segment_bytes=1000)
    parts = warc._scan(spark, path, payloads=False).filter("number IS NOT NULL")
    assert warc.reassemble(parts).first()["payload"] == bytearray(b"x" * 5000)
    with pytest.raises(Exception, match="segments of a record are missing"):
        warc.reassemble(parts.filter("number <> 2")).collect()
    with pytest.raises(Exception, match="segments of a record are missing"):
        warc.reassemble(parts.filter(F.col("total").isNull())).collect()


def test_segments_are_taken_as_a_stream(spark):
    """No call for each page: segments of a page come in several batches, pages leave many to a batch."""
    rows = [(i, "u", f"{i} " * (300 + i)) for i in range(40)] + [(None, None, "é" * 900)]
    path, got = _read(spark, rows, segment_bytes=100)
    assert got == _expected(rows)
    parts = warc._scan(spark, path, payloads=False).filter("number IS NOT NULL")
    whole = warc.reassemble(parts)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    at = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = {r["page_id"]: (r["url"], bytes(r["payload"])) for r in whole.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at)
    assert found == {i: (u, html.encode()) for i, u, html in rows}


def test_rows_leave_many_to_a_batch():
    rows = [((i, b"x" * 1000), 1000) for i in range(20_000)]
    batches = list(warc._in_batches(iter(rows), ["i", "b"], [pa.int64(), pa.binary()]))
    assert len(batches) < 10 and max(b.nbytes for b in batches) < 2 * warc._HELD_BYTES
    assert list(warc._rows(iter(batches))) == [row for row, _ in rows]
    assert [b.num_rows for b in warc._in_batches((((i,), 0) for i in range(warc._HELD_ROWS + 1)), ["i"], [pa.int64()])] == [warc._HELD_ROWS, 1]
    assert list(warc._in_batches(iter([]), ["i"], [pa.int64()])) == []


def test_damaged_archives_are_noticed():
    good = b"".join(r + warc.END for r in warc.page_records(1, "u", b"abc", None))
    (fields, block), = warc.records_of(good)
    assert warc.http_payload(block) == b"abc" and fields["warc-payload-digest"] == "sha1:" + warc.payload_digest(b"abc")
    with pytest.raises(ValueError):
        list(warc.records_of(good[:-6]))
    with pytest.raises(ValueError):
        list(warc.records_of(b"junk" + good))
    with pytest.raises(ValueError):
        warc._checked(b"abd", warc.payload_digest(b"abc"))


def test_pages_of_the_query_are_reassembled(spark, sf_dir):
    """The query's own archives hold continuation records, and the pages that come from them are right."""
    path = scratch_path(spark, "archives")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html", path)
    records = warc._scan(spark, path, payloads=False)
    assert records.filter("number > 1").count() >= 1
    segmented = {r["page_id"] for r in records.filter("number > 1").select("page_id").collect()}
    html = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    read = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, path).filter("record_type = 'response'").collect()}
    assert segmented and all(read[i] == html[i] and len(html[i]) > 4000 for i in segmented)


def test_equal_pages_without_an_id_are_not_one_task(spark):
    rows = [(None, "u", "same")] * 400
    path = scratch_path(spark, "archives")
    warc.write_archives(spark.createDataFrame(rows, _SCHEMA), "page_id", "url", "html", path, archive_bytes=100)
    sizes = [r["n"] for r in spark.read.text(path, lineSep="\r\n\r\n").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < 200
