"""Queries over message extraction, end-to-end jobs and incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailrisk.functions import text as X
from mailrisk.operators import messages, rows, scoring
from mailrisk.operators.language import fit_language
from mailrisk.plans import jobs
from mailrisk.plans import standins as I
from mailrisk.plans.cohort_queries import COUNTRY_SQL, language_sql
from mailrisk.plans.registry import query, spread_table, table
from mailrisk.plans.text_queries import bayes_sql
from mailrisk.session import scratch_path
from mailrisk.sources import readers, writers
from mailrisk.streaming.incremental import ingest_incremental


@query("extract_messages", I.EXTRACTED_SQL)
def _(spark, d):
    out = messages.extract_messages(I.document_messages(spark, d))
    return out.select("msg_id", "content_type", "email_text", "html")


@query(
    "select_body",
    f"SELECT msg_id, content_type, CASE WHEN content_type = 'text/html' AND html LIKE '%<style>%' THEN '' ELSE email_text END AS email_text, html FROM ({I.EXTRACTED_SQL})",
)
def _(spark, d):
    parsed = messages.parse_messages(I.document_messages(spark, d))
    return messages.select_body(messages.explode_parts(parsed))


@query(
    "message_parts",
    """SELECT doc_id AS msg_id, i::INT AS idx, lang IN ('en', 'de') AS is_multipart FROM documents,
    LATERAL (SELECT unnest(range(CASE WHEN lang IN ('en', 'de') THEN 3 ELSE 1 END)) AS i)""",
)
def _(spark, d):
    parsed = messages.parse_messages(I.document_messages(spark, d))
    return messages.explode_parts(parsed).select("msg_id", "idx", "is_multipart")


@query("decode_subject", "SELECT doc_id, source || ' ' || lang AS subject, NULL::VARCHAR AS subject_error FROM documents")
def _(spark, d):
    plain = F.concat("source", F.lit(" "), "lang")
    coded = F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(plain, "UTF-8")), F.lit("?="))
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", plain).otherwise(coded).alias("subject"))
    return messages.decode_subject(docs)


_MARK = "chr(1)"
_PIECES = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', chr(1), 'g'),
  '(?s)<!--.*?-->', chr(1), 'g'), '</?[a-zA-Z!][^>]*>', chr(1), 'g')"""
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _unescape_sql(c: str) -> str:
    for name, char in _ENTITIES:
        c = rf"regexp_replace({c}, '{name}|{name[:-1]}\b', '{char}', 'g')"
    return c


@query(
    "html_to_text",
    f"""SELECT page_id, array_to_string(list_filter(list_transform(string_split({_PIECES}, chr(1)), lambda x: {I.strip_sql(_unescape_sql('x'))}), lambda x: x <> ''), ' ') AS text FROM pages""",
)
def _(spark, d):
    return spread_table(spark, d, "pages").select("page_id", messages.html_to_text("html").alias("text"))


# --- jobs ------------------------------------------------------------------------


def _raw_documents(spark, d):
    """Raw events, each with a document as its message: the documents in turn, and their source before the subject."""
    number = F.expr("cast(substring(event.payload.msgid, 2) AS bigint)") % table(spark, d, "documents").count()
    events = I.raw_events(spark, d).select(number.alias("msg_id"), "event")
    docs = I.document_messages(spark, d).select("msg_id", "source", F.col("mime").alias("raw_mime"))
    payload = F.col("event.payload")
    payload = payload.withField("subject", F.concat("source", F.lit(" "), payload["subject"]))
    # events and messages are far wider than the tables they are made of: by a shuffle, whatever the files' size
    return events.join(docs.hint("merge"), "msg_id").select("raw_mime", F.struct(payload.alias("payload")).alias("event"))


_NUMBER = "event_id % (SELECT count(*) FROM documents)"
_SUBJECTS = f"""SELECT event_id AS id, source || ' ' || CASE WHEN value >= 5 THEN event_type || ' ' || props ELSE '' END AS text
  FROM events JOIN documents ON doc_id = {_NUMBER}"""
_INGESTED = f"""SELECT f.user_id, f.msg_id, f.sg_event_id, s.text AS subject, f.email_from, f.email_to, f.email_date, f.originating_ip,
      c.originating_ip_country, l.detected AS lang, x.content_type, x.email_text, nullif(x.html, '') AS html
    FROM events e JOIN ({I.EXTRACTED_SQL}) x ON x.msg_id = e.{_NUMBER} JOIN ({I.FLAT_SQL}) f ON f.msg_id = 'm' || e.event_id
    JOIN ({COUNTRY_SQL}) c USING (event_id) JOIN ({_SUBJECTS}) s ON s.id = e.event_id
    JOIN ({language_sql(_SUBJECTS)}) l ON l.id = e.event_id"""
_MAIL = ["user_id", "msg_id", "sg_event_id", "subject", "email_from", "email_to", "email_date", "originating_ip"]
_MAIL += ["originating_ip_country", "lang", "content_type", "email_text", "html"]


def _ingested(spark, path):
    """Mails with their HTML bodies, from the tables of an ingest; nothing may be in quarantine.

    Files of bodies can be a small part of the bodies' size: they are joined by a shuffle, never broadcast.
    """
    if readers.scan_parquet(spark, f"{path}/quarantine").count():
        raise AssertionError("records in quarantine")
    html = readers.scan_parquet(spark, f"{path}/html").select("msg_id", "html")
    return readers.scan_parquet(spark, f"{path}/mails").join(html.hint("merge"), "msg_id", "left").select(*_MAIL)


@query("ingest_job", _INGESTED)
def _(spark, d):
    language = fit_language(spread_table(spark, d, "documents"))
    path = scratch_path(spark, "ingest")
    writers.write_json_lines(_raw_documents(spark, d), f"{path}/in")
    raw = readers.scan_json_lines(spark, f"{path}/in")
    jobs.write_ingested(raw, f"{path}/out", I.nation_ranges(spark, d), language)
    return _ingested(spark, f"{path}/out")


@query(
    "ingest_job_quarantine",
    "SELECT lang = 'en' AS good, count(*) AS n FROM documents GROUP BY 1",
)
def _(spark, d):
    """Events whose message is missing go to quarantine."""
    raw = I.document_messages(spark, d)
    raw = raw.withColumn("mime", F.when(F.col("lang") == "en", F.col("mime")))
    path = scratch_path(spark, "ingest")
    extracted = messages.extract_messages(raw).withColumnRenamed("parse_error", "error")
    writers.write_parquet(extracted.select("msg_id", "email_text", "error"), path)
    good, bad = jobs.split_errors(spark.read.parquet(path))
    both = good.select(F.lit(True).alias("good")).unionByName(bad.select(F.lit(False).alias("good")))
    return both.groupBy("good").agg(F.count(F.lit(1)).alias("n"))


def _mark(code):
    return lambda: lambda texts: [f"[{code}] {t}" for t in texts]


@query(
    "preprocess_job",
    f"""SELECT msg_id, {I.domains_sql('email_text')} AS url_domains, {I.clean_sql(I.shorten_sql('email_text'))} AS cleaned_text,
    CASE WHEN lang = 'fr' THEN '[fr] ' ELSE '' END || {I.clean_sql(I.shorten_sql('email_text'))} AS translated_text,
    CASE WHEN lang = 'fr' THEN '[fr] ' ELSE '' END || source AS subject
    FROM ({I.EXTRACTED_SQL}) JOIN (SELECT doc_id AS msg_id, lang, source FROM documents) USING (msg_id)""",
)
def _(spark, d):
    raw = I.document_messages(spark, d).withColumnRenamed("source", "subject")
    out = jobs.preprocess(messages.extract_messages(raw), {"fr": _mark("fr")})
    return out.select("msg_id", "url_domains", "cleaned_text", "translated_text", "subject")


# A document with the link of the page of its number at the end.
_LINKED = """SELECT doc_id AS id, source, text || ' ' || coalesce(url, '') AS email_text, toxic, quality
  FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN pages ON page_id = doc_id"""
_WORDS = bayes_sql(
    f"SELECT toxic AS y, email_text AS text FROM ({_LINKED}) WHERE toxic IS NOT NULL",
    f"SELECT id, {I.strip_sql('source || chr(32) || ' + I.clean_sql(I.shorten_sql('email_text')))} AS text FROM ({_LINKED})",
)
_LINKS = bayes_sql(
    f"SELECT quality AS y, {I.domains_sql('email_text')} AS text FROM ({_LINKED}) WHERE quality IS NOT NULL",
    f"SELECT id, {I.domains_sql('email_text')} AS text FROM ({_LINKED})",
)


@query(
    "score_job",
    f"""SELECT w.id AS msg_id, w.label AS words_label, w.score AS words_score, l.label AS links_label, l.score AS links_score
    FROM ({_WORDS}) w JOIN ({_LINKS}) l USING (id)""",
)
def _(spark, d):
    """One model reads subject and body, the other the link domains."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    docs = spread_table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").join(pages, "doc_id", "left")
    mails = docs.select(
        F.col("doc_id").alias("msg_id"),
        F.col("source").alias("subject"),
        F.concat("text", F.lit(" "), F.coalesce("url", F.lit(""))).alias("email_text"),
        "toxic",
        "quality",
    )
    train = mails.withColumn("url_domains", X.url_domains("email_text"))
    models = [
        scoring.bayes_model("words", train, "email_text", "toxic", "translated_text"),
        scoring.bayes_model("links", train, "url_domains", "quality"),
    ]
    out = jobs.score(mails.drop("toxic", "quality"), models)
    return out.select("msg_id", *[c for m in models for c in (m.label_col, m.score_col)])


@query("assert_unique_columns", "SELECT doc_id, quality, toxic FROM labels")
def _(spark, d):
    df = table(spark, d, "labels")
    try:
        rows.assert_unique_columns(df.select("doc_id", "doc_id"))
    except ValueError:
        return rows.union_frames(df)
    raise AssertionError("duplicate columns were let through")


@query("ingest_incremental", _INGESTED)
def _(spark, d):
    """Files of two event types, then all: the second run must add only the new ones, a third nothing."""
    language = fit_language(spread_table(spark, d, "documents"))
    base = scratch_path(spark, "incremental")
    run = dict(source=f"{base}/in", target=f"{base}/out", checkpoint=f"{base}/state")
    run |= dict(ranges=I.nation_ranges(spark, d), language=language)
    raw = _raw_documents(spark, d)
    early = F.expr("cast(substring(event.payload.msgid, 2) AS bigint)") % 3 == 0
    writers.write_json_lines(raw.filter(early), f"{base}/in", "append")
    ingest_incremental(spark, **run)
    writers.write_json_lines(raw.filter(~early), f"{base}/in", "append")
    ingest_incremental(spark, **run)
    if ingest_incremental(spark, **run):
        raise AssertionError("a run without new files wrote rows")
    return _ingested(spark, f"{base}/out")
