"""Queries over readers, writers, projections and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailrisk import schema as S
from mailrisk.functions import text as X
from mailrisk.operators import ranking, rows
from mailrisk.plans import standins as I
from mailrisk.plans.registry import query, table
from mailrisk.session import scratch_path
from mailrisk.sources import readers, writers

_FLAT = ["user_id", "msg_id", "sg_event_id", "subject", "mime", "email_from", "email_to", "email_date", "originating_ip"]


def _json_by_day(spark, d):
    """Raw events as gzip JSON lines below ``day=`` folders."""
    path = scratch_path(spark, "json")
    raw = I.raw_events(spark, d).drop("event_type")
    raw.repartitionByRange("day", "event.payload.sg_event_id").write.partitionBy("day").option("compression", "gzip").json(path)
    return path


@query("scan_json_lines", I.FLAT_SQL)
def _(spark, d):
    raw = readers.scan_json_lines(spark, _json_by_day(spark, d))
    return rows.flatten_event(raw).select(*_FLAT)


@query("scan_day", f"SELECT * FROM ({I.FLAT_SQL}) WHERE email_date = '2024-01-07'")
def _(spark, d):
    return rows.flatten_event(readers.scan_day(spark, _json_by_day(spark, d), "20240107")).select(*_FLAT)


@query("scan_user_json", "SELECT user_id, user_id AS path_user, 'm' || event_id AS msg_id, true AS has_file FROM events")
def _(spark, d):
    path = scratch_path(spark, "users") + "/users"
    raw = I.raw_events(spark, d).select("raw_mime", "event", F.col("event.payload.userid").alias("uid"))
    raw.repartitionByRange("uid", "event.payload.sg_event_id").write.partitionBy("uid").json(path)
    df = rows.flatten_event(readers.scan_user_json(spark, path))
    is_file = X.file_name("s3_path").endswith(".json")
    return df.select("user_id", "path_user", "msg_id", is_file.alias("has_file"))


@query("with_source_path", "SELECT 'events.parquet' AS file, count(*) AS n FROM events")
def _(spark, d):
    df = readers.with_source_path(readers.scan_parquet(spark, f"{d}/events.parquet"))
    return df.groupBy(X.file_name("s3_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))


def _split_orders(spark, d):
    base = scratch_path(spark, "orders")
    orders = table(spark, d, "orders")
    writers.write_parquet(orders.filter("o_orderstatus = 'F'"), f"{base}/part1")
    writers.write_parquet(orders.filter("o_orderstatus <> 'F'"), f"{base}/part2")
    return f"{base}/part1", f"{base}/part2"


@query("scan_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    return readers.scan_parquet(spark, *_split_orders(spark, d)).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "union_locations",
    "SELECT CASE WHEN o_orderstatus = 'F' THEN 'part1' ELSE 'part2' END AS location, count(*) AS n FROM orders GROUP BY 1",
)
def _(spark, d):
    df = readers.with_source_path(readers.scan_parquet(spark, *_split_orders(spark, d)))
    location = F.element_at(F.split("s3_path", "/"), -2)
    return df.groupBy(location.alias("location")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_csv_multiline", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, d):
    path = scratch_path(spark, "csv")
    docs = table(spark, d, "documents")
    writers.write_csv(docs, path)
    return readers.scan_csv(spark, path, docs.schema)


@query(
    "write_numbered_csv",
    f"""SELECT row_number() OVER (ORDER BY dataset, msg_id) - 1 AS row, msg_id, dataset, two_score FROM ({I.SCORED_SQL})""",
)
def _(spark, d):
    path = scratch_path(spark, "sheet")
    sheet = I.scored_mails(spark, d).select("msg_id", "dataset", "two_score")
    writers.write_csv(sheet, path, number_by=["dataset", "msg_id"])
    stored = T.StructType([T.StructField("row", T.LongType()), *sheet.schema])
    return readers.scan_csv(spark, path, stored)


@query("scan_warehouse", "SELECT user_id, count(*) AS email_count FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id")
def _(spark, d):
    table(spark, d, "events").createOrReplaceTempView("mail_log")
    sql = "SELECT user_id AS USER_ID, count(*) AS EMAIL_COUNT FROM mail_log WHERE ts >= TIMESTAMP_NTZ '2024-01-15' GROUP BY user_id"
    return readers.scan_warehouse(spark, sql)


@query("scan_id_list", "SELECT c_custkey::VARCHAR AS user_id FROM customer")
def _(spark, d):
    path = scratch_path(spark, "ids")
    # every second line blank, ids with white space around them
    line = F.explode(F.array(F.concat(F.lit(" \t"), F.col("c_custkey").cast("string"), F.lit(" ")), F.lit("   ")))
    table(spark, d, "customer").select(line.alias("value")).write.text(path)
    return readers.scan_id_list(spark, path)


@query("scan_map", "SELECT doc_id || '.html' AS filename, 'f' || doc_id AS file_id FROM labels")
def _(spark, d):
    path = scratch_path(spark, "map")
    name, fid = X.html_key(F.col("doc_id").cast("string")), F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    table(spark, d, "labels").select(F.to_json(F.create_map(name, fid)).alias("value")).write.text(path)
    return readers.scan_map(spark, path)


@query(
    "scan_embeddings",
    f"""SELECT dataset, count(*) AS n, sum(len(embedding))::BIGINT AS n_values, round(sum(list_sum(embedding::DOUBLE[])), 6) AS total
    FROM ({I.SETS_SQL}) GROUP BY dataset""",
)
def _(spark, d):
    path = scratch_path(spark, "embeddings")
    I.embedding_sets(spark, d).write.parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return (
        readers.scan_embeddings(spark, path)
        .groupBy("dataset")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).alias("n_values"), F.round(F.sum(total), 6).alias("total"))
    )


@query("write_parquet", "SELECT event_id, ts, user_id, event_type, value FROM events")
def _(spark, d):
    path = scratch_path(spark, "parquet")
    df = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    writers.write_parquet(df, path)
    return readers.scan_parquet(spark, path)


@query(
    "write_per_user",
    "SELECT user_id, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event, 0::BIGINT AS out_of_order FROM events GROUP BY user_id",
)
def _(spark, d):
    path = scratch_path(spark, "per_user")
    writers.write_per_user(table(spark, d, "events").select("user_id", "event_id", "ts"), path, order="event_id", partitions=8)


    # the type of a partition column is declared, not guessed from folder names
    stored = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType())])
    df = readers.scan_parquet(spark, path, schema=stored)
    row = F.col("_metadata.row_index")
    df = df.select("user_id", "event_id", F.col("_metadata.file_name").alias("f"), row.alias("r"))
    # in each file the event ids must rise with the row number
    w = Window.partitionBy("user_id", "f").orderBy("r")
    df = df.withColumn("bad", (F.lag("event_id").over(w) > F.col("event_id")).cast("int"))
    return df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_id").alias("first_event"),
        F.max("event_id").alias("last_event"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("out_of_order"),
    )


_BATCHED = """SELECT doc_id, row_index, row_index // 300 AS batch_no,
  (row_index // 300 * 300)::VARCHAR || '-' || (row_index // 300 * 300 + 299)::VARCHAR AS batch_id
  FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents)"""


@query("assign_batches", _BATCHED)
def _(spark, d):
    return ranking.assign_batches(table(spark, d, "documents").select("doc_id"), ["doc_id"], 300, ranges=8)


@query(
    "assign_batches_clipped",
    _BATCHED.replace("row_index // 300 * 300 + 299", "least(row_index // 300 * 300 + 299, (SELECT count(*) FROM documents) - 1)"),
)
def _(spark, d):
    return ranking.assign_batches(table(spark, d, "documents").select("doc_id"), ["doc_id"], 300, ranges=8, clip=True)


@query("write_batches", f"SELECT batch_id, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM ({_BATCHED}) GROUP BY batch_id")
def _(spark, d):
    path = scratch_path(spark, "batches")
    writers.write_batches(table(spark, d, "documents").select("doc_id", "text"), path, ["doc_id"], 300)
    df = spark.read.schema("doc_id bigint, batch_id string").parquet(path)
    return df.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


@query(
    "sorted_inputs",
    """SELECT event_id, day_no // 10 AS batch_no, (day_no // 10 * 5000)::VARCHAR || '-' || (day_no // 10 * 5000 + 4999)::VARCHAR AS batch_id
    FROM (SELECT event_id, dense_rank() OVER (ORDER BY ts::DATE) - 1 AS day_no FROM events)""",
)
def _(spark, d):
    path = scratch_path(spark, "days")
    events = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd").alias("day"))
    # the name of a written file sorts by its folder first: one file per day and task
    events.repartition("day").write.partitionBy("day").parquet(path)
    df = readers.with_source_path(readers.scan_parquet(spark, path)).select("event_id", "s3_path")
    return ranking.file_batches(df, 10, 500, spread="event_id").select("event_id", "batch_no", "batch_id")


@query("write_html_bodies", "SELECT page_id::VARCHAR AS msg_id, page_id || '.html' AS html_key, html FROM pages WHERE html <> ''")
def _(spark, d):
    path = scratch_path(spark, "html")
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("msg_id"), "html")
    writers.write_html_bodies(pages, path)
    return readers.scan_parquet(spark, path)


@query(
    "write_resumable",
    "SELECT event_type AS s3_path, count(*) AS n, 5 - 2 AS second_run FROM events GROUP BY event_type",
)
def _(spark, d):
    path = scratch_path(spark, "resumable")
    df = table(spark, d, "events").select("event_id", F.col("event_type").alias("s3_path"))
    writers.write_resumable(spark, df.filter("s3_path IN ('view', 'click')"), path, "event_id")
    left = writers.write_resumable(spark, df, path, "event_id")
    out = writers.read_resumable(spark, path)
    return out.groupBy("s3_path").agg(F.count(F.lit(1)).alias("n")).withColumn("second_run", F.lit(left))


@query("sample_files", "SELECT 4::BIGINT AS n_files, 4::BIGINT AS n_whole, 0::BIGINT AS n_foreign")
def _(spark, d):
    """Files of orders by their key modulo 16; every row of a picked file must be there, and no other."""
    path = scratch_path(spark, "files")
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 16).alias("part"))
    orders.repartition(16, "part").write.partitionBy("part").parquet(path)
    picked = readers.with_source_path(readers.sample_files(spark, [path], 4))
    rest = F.col("o_orderkey") % 16
    found = picked.groupBy("s3_path", rest.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    named = F.regexp_extract("s3_path", "part=([0-9]+)/", 1).cast("bigint")
    there = orders.groupBy("part").agg(F.count(F.lit(1)).alias("all"))
    return found.join(there, "part").agg(
        F.count_distinct("s3_path").alias("n_files"),
        F.count_if(F.col("n") == F.col("all")).alias("n_whole"),
        F.count_if(named != F.col("part")).alias("n_foreign"),
    )


@query("drop_empty_frames", "SELECT o_orderstatus, 2 * count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    """Files without rows, a frame without rows and an empty line file add nothing."""
    path = scratch_path(spark, "empty")
    orders = table(spark, d, "orders").select("o_orderstatus")
    orders.write.parquet(f"{path}/full")
    orders.limit(0).write.parquet(f"{path}/none")
    orders.select(F.to_json(F.struct("o_orderstatus")).alias("value")).write.text(f"{path}/lines")
    orders.limit(0).select("o_orderstatus").write.mode("append").text(f"{path}/lines")
    files = readers.scan_parquet(spark, f"{path}/full", f"{path}/none")
    lines = spark.read.schema(orders.schema).json(f"{path}/lines")
    both = rows.union_frames(files, readers.scan_parquet(spark, f"{path}/none"), lines)
    return both.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# --- projections and filters ---------------------------------------------------


@query("flatten_event", I.FLAT_SQL)
def _(spark, d):
    return rows.flatten_event(I.raw_events(spark, d).drop("day"))


@query("flatten_event_dotted", I.FLAT_SQL)
def _(spark, d):
    path = scratch_path(spark, "flat")
    raw = I.raw_events(spark, d).drop("day")
    fields = [F.col(f"event.payload.`{f.name}`").alias(f"event.payload.{f.name}") for f in S.PAYLOAD]
    raw.select("raw_mime", *fields).write.parquet(path)
    return rows.flatten_event(readers.scan_parquet(spark, path, schema=S.RAW_EVENT_FLAT))


def _with_bad_lines(spark, d):
    """Raw lines, plus a cut line for every error, one without body for every signup, one without payload for every view."""
    path = scratch_path(spark, "bad")
    raw = I.raw_events(spark, d)
    line = F.to_json(F.struct("raw_mime", "event"))
    cut = F.when(F.col("event_type") == "error", F.expr("substring(line, 1, 30)"))
    no_body = F.when(F.col("event_type") == "signup", F.to_json(F.struct("event")))
    no_payload = F.when(F.col("event_type") == "view", F.to_json(F.struct("raw_mime")))
    lines = raw.withColumn("line", line).select(F.explode(F.array("line", cut, no_body, no_payload)).alias("value"))
    lines.filter("value IS NOT NULL").write.text(path)
    return readers.split_bad_records(readers.scan_json_lines(spark, path))


@query("split_bad_records", I.FLAT_SQL)
def _(spark, d):
    good, _bad = _with_bad_lines(spark, d)
    return rows.flatten_event(good).select(*_FLAT)


@query(
    "bad_records",
    r"""SELECT 'unreadable line' AS reason, NULL::VARCHAR AS msg_id, NULL::VARCHAR AS raw_mime,
      left('{"raw_mime":"Subject: x\n\n' || replace(props, '"', '\"'), 30) AS line FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'missing raw_mime', 'm' || event_id, NULL, NULL FROM events WHERE event_type = 'signup'
    UNION ALL SELECT 'missing event.payload', NULL, 'Subject: x' || chr(10) || chr(10) || props, NULL FROM events WHERE event_type = 'view'""",
)
def _(spark, d):
    """What the quarantined records hold."""
    _good, bad = _with_bad_lines(spark, d)
    return bad.select(
        "reason",
        F.get_json_object("record", "$.event.payload.msgid").alias("msg_id"),
        F.get_json_object("record", "$.raw_mime").alias("raw_mime"),
        F.when(F.col("reason") == "unreadable line", F.col("record")).alias("line"),
    )


@query(
    "expand_struct",
    "SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events",
)
def _(spark, d):
    df = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("s"))
    return rows.expand_struct(df, "s")


@query("recent_notes", "SELECT user_id, event_id, ts AS created_at FROM events WHERE event_type LIKE '%err%' AND ts >= TIMESTAMP '2024-01-15'")
def _(spark, d):
    notes = table(spark, d, "events").withColumnsRenamed({"ts": "created_at", "event_type": "agent_notes"})
    return rows.recent_notes(notes, "err", I.as_of()).select("user_id", "event_id", "created_at")


@query("null_defaults", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, '') AS subject FROM customer")
def _(spark, d):
    subject = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    df = table(spark, d, "customer").select("c_custkey", subject.alias("subject"))
    return rows.null_defaults(df, "subject")


@query(
    "parse_dates",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts, '%Y-%m-%d 00:00:00') END AS parsed FROM events",
)
def _(spark, d):
    written = F.when(F.col("event_type") == "error", F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    df = table(spark, d, "events").select("event_id", written.alias("parsed"))
    return rows.parse_dates(df, "parsed").withColumn("parsed", F.date_format("parsed", "yyyy-MM-dd HH:mm:ss"))


@query("as_text", "SELECT doc_id, coalesce(quality::VARCHAR, '') AS quality_text FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, d):
    df = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return df.select("doc_id", X.as_text("quality").alias("quality_text"))


@query(
    "filter_predicates",
    f"""SELECT msg_id, dataset, two_score FROM ({I.SCORED_SQL}) WHERE two_label = 1 AND two_score >= 0.99
    OR two_label = 0 AND dataset = 'Good User'""",
)
def _(spark, d):
    phish = (F.col("two_label") == 1) & (F.col("two_score") >= 0.99)
    legit = (F.col("two_label") == 0) & (F.col("dataset") == "Good User")
    return I.scored_mails(spark, d).filter(phish | legit).select("msg_id", "dataset", "two_score")


@query("row_count", "SELECT count(*) AS n_rows, 6::BIGINT AS n_columns FROM events")
def _(spark, d):
    return rows.row_count(table(spark, d, "events"))


@query("distinct_values", "SELECT DISTINCT lang FROM documents")
def _(spark, d):
    return rows.distinct_values(table(spark, d, "documents"), "lang")


@query(
    "union_frames",
    """SELECT doc_id, text, lang, NULL::VARCHAR AS role FROM documents
    UNION ALL SELECT conv_id, text, NULL, role FROM conversations UNION ALL SELECT item_id, text, NULL, NULL FROM benchmark""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    talks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text", "role")
    items = table(spark, d, "benchmark").select("text", F.col("item_id").alias("doc_id"))
    return rows.union_frames(docs, talks, items)


@query("union_tagged", "SELECT doc_id AS id, text, 'mail' AS dataset FROM documents UNION ALL SELECT item_id, text, 'corpus' FROM benchmark")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return rows.union_tagged({"mail": docs, "corpus": items})
