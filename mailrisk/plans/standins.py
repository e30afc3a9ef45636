"""How the test tables stand in for mail data, in Spark and in SQL.

``events`` is the mail log, ``documents`` are mail bodies, ``pages`` HTML
bodies, ``embeddings`` embedding sets and model outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.functions import scores as C
from mailrisk.plans.registry import spread_table, table

AS_OF = "2024-03-15 00:00:00"  # two months earlier lies inside the events


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


# --- events as raw mail events ------------------------------------------------

# Octets from ids; one event type has no address, one a malformed one.
IP_SQL = """CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN 'not an address'
  ELSE (user_id % 60)::VARCHAR || '.' || (event_id % 256)::VARCHAR || '.'
       || (user_id % 256)::VARCHAR || '.' || (event_id % 251)::VARCHAR END"""


def ip_of_event() -> Column:
    octets = [F.col("user_id") % 60, F.col("event_id") % 256, F.col("user_id") % 256, F.col("event_id") % 251]
    dotted = F.concat_ws(".", *[o.cast("string") for o in octets])
    return (
        F.when(F.col("event_type") == "signup", F.lit(None).cast("string"))
        .when(F.col("event_type") == "error", F.lit("not an address"))
        .otherwise(dotted)
    )


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    """Nested raw events; the subject is empty for negative or small values."""
    e = table(spark, d, "events")
    payload = F.struct(
        F.col("user_id").alias("userid"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("msgid"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("sg_event_id"),
        F.when(F.col("value") >= 5, F.concat("event_type", F.lit(" "), "props")).otherwise(F.lit("")).alias("subject"),
        F.concat(F.lit("from"), F.col("user_id").cast("string"), F.lit("@a.example")).alias("from"),
        F.concat(F.lit("to"), F.col("event_id").cast("string"), F.lit("@b.example")).alias("email"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        ip_of_event().alias("originating_ip"),
    )
    return e.select(
        F.concat(F.lit("Subject: x\n\n"), F.col("props")).alias("raw_mime"),
        F.struct(payload.alias("payload")).alias("event"),
        F.date_format("ts", "yyyyMMdd").alias("day"),
        "event_type",
    )


FLAT_SQL = f"""SELECT user_id, 'm' || event_id AS msg_id, lpad(event_id::VARCHAR, 12, '0') AS sg_event_id,
  CASE WHEN value >= 5 THEN event_type || ' ' || props END AS subject,
  'Subject: x' || chr(10) || chr(10) || props AS mime,
  'from' || user_id || '@a.example' AS email_from, 'to' || event_id || '@b.example' AS email_to,
  strftime(ts, '%Y-%m-%d') AS email_date, {IP_SQL} AS originating_ip FROM events"""


# --- events as mails and suspensions ------------------------------------------


def dated_mails(spark: SparkSession, d: str) -> DataFrame:
    """Mails with a date-only ``email_date``."""
    day = F.col("ts").cast("date").cast("timestamp_ntz")
    return table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("msg_id"), day.alias("email_date"), "event_type"
    )


DATED_SQL = "SELECT user_id, event_id AS msg_id, ts::DATE::TIMESTAMP AS email_date, event_type FROM events"


def suspension_notes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'error'")
    return e.select("user_id", F.col("ts").alias("created_at"))


SUSPENDED_SQL = "SELECT user_id, max(ts) AS created_at FROM events WHERE event_type = 'error' GROUP BY user_id"

# --- nation as address ranges --------------------------------------------------


def nation_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Even nations own most of one first octet, odd ones a few unaligned blocks."""
    key = F.col("n_nationkey").cast("bigint")
    base = (key + 1) * 16777216
    even = key % 2 == 0
    return table(spark, d, "nation").select(
        F.when(even, base).otherwise(base + 100 * 65536 + 77).alias("start_ip"),
        F.when(even, base + 200 * 65536 + 11).otherwise(base + 160 * 65536 + 5).alias("end_ip"),
        F.when(F.col("n_regionkey") != 3, F.col("n_name")).alias("country"),
    )


RANGES_SQL = """SELECT CASE WHEN k % 2 = 0 THEN b ELSE b + 100 * 65536 + 77 END AS start_ip,
  CASE WHEN k % 2 = 0 THEN b + 200 * 65536 + 11 ELSE b + 160 * 65536 + 5 END AS end_ip,
  CASE WHEN n_regionkey <> 3 THEN n_name END AS country
  FROM (SELECT *, n_nationkey::BIGINT AS k, (n_nationkey::BIGINT + 1) * 16777216 AS b FROM nation)"""

# --- embeddings as embedding sets and as model outputs --------------------------

# Names of the embedding sets (fixed values).
SET_OF_LABEL = {
    0: "phish", 1: "phish", 2: "phish", 3: "not-phish", 4: "not-phish",
    5: "good-users", 6: "good-users", 7: "phish-users", 8: "phish-users", 9: "phish-users",
}
SET_PAIRS = [
    ("phish", "not-phish"), ("phish", "good-users"), ("phish", "phish-users"),
    ("not-phish", "good-users"), ("not-phish", "phish-users"), ("good-users", "phish-users"),
]
_SET_SQL = "CASE " + " ".join(f"WHEN label = {k} THEN '{v}'" for k, v in SET_OF_LABEL.items()) + " END"


def embedding_sets(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(SET_OF_LABEL[k]) for k in range(10)])
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.get(names, F.col("label")).alias("dataset"), "embedding"
    )


SETS_SQL = f"SELECT vec_id AS id, {_SET_SQL} AS dataset, embedding FROM embeddings"

MODELS = ["two", "four", "named"]
SCALE = 20.0


def logits(first: int, count: int) -> Column:
    """Model output stand-in: a slice of the vector, scaled so that scores spread out."""
    part = F.slice("embedding", first, count)
    return F.transform(part, lambda x: x.cast("double") * SCALE)


def named_output() -> tuple[Column, Column]:
    e = F.get("embedding", F.lit(6)).cast("double")
    name = F.when(e > 0, F.lit("phishing")).otherwise(F.lit("benign"))
    return name, F.lit(1.0) / (F.lit(1.0) + F.exp(F.abs(e) * -SCALE))


def scored_mails(spark: SparkSession, d: str) -> DataFrame:
    """Mails with labels and scores of three models in two data sets."""
    name, score = named_output()
    df = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("msg_id"),
        F.when(F.col("label") < 5, F.lit("Suspended User")).otherwise(F.lit("Good User")).alias("dataset"),
        C.softmax(logits(1, 2)).alias("p2"),
        C.softmax(logits(3, 4)).alias("p4"),
        name.alias("n"),
        score.alias("s"),
    )
    return df.select(
        "msg_id",
        "dataset",
        C.label_two_class("p2").alias("two_label"),
        C.score_two_class("p2").alias("two_score"),
        C.label_four_class("p4").alias("four_label"),
        C.score_four_class("p4").alias("four_score"),
        C.label_named("n").alias("named_label"),
        C.score_named("n", "s").alias("named_score"),
    )


def _softmax_sql(first: int, count: int) -> str:
    x = [f"(embedding[{i}]::DOUBLE * {SCALE})" for i in range(first, first + count)]
    top = f"greatest({', '.join(x)})"
    exps = [f"exp({v} - {top})" for v in x]
    return "[" + ", ".join(f"{e} / ({' + '.join(exps)})" for e in exps) + "]"


SCORED_SQL = f"""SELECT msg_id, dataset, i2 AS two_label, round(CASE WHEN i2 = 1 THEN m2 ELSE 1 - m2 END, 6) AS two_score,
  i4 % 2 AS four_label, round(CASE WHEN i4 % 2 = 1 THEN m4 ELSE 1 - m4 END, 6) AS four_score,
  CASE WHEN e > 0 THEN 1 ELSE 0 END AS named_label, round(CASE WHEN e > 0 THEN s ELSE 1 - s END, 6) AS named_score
  FROM (SELECT *, list_max(p2) AS m2, list_max(p4) AS m4, list_position(p2, list_max(p2)) - 1 AS i2,
    list_position(p4, list_max(p4)) - 1 AS i4, 1 / (1 + exp(abs(e) * -{SCALE})) AS s
    FROM (SELECT vec_id AS msg_id, CASE WHEN label < 5 THEN 'Suspended User' ELSE 'Good User' END AS dataset,
      {_softmax_sql(1, 2)} AS p2, {_softmax_sql(3, 4)} AS p4, embedding[7]::DOUBLE AS e FROM embeddings))"""

LONG_SQL = f"""SELECT msg_id, dataset, unnest(['two', 'four', 'named']) AS model,
  unnest([two_label, four_label, named_label]) AS label, unnest([two_score, four_score, named_score]) AS score
  FROM ({SCORED_SQL})"""

# --- documents as raw messages ---------------------------------------------------


def _b64(c: Column) -> Column:
    return F.base64(F.encode(c, "UTF-8"))


def _quoted(c: Column) -> Column:
    """Quoted-printable with every byte escaped, in lines of 72 characters."""
    escaped = F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "=$1")
    return F.regexp_replace(escaped, "((?:=..){24})", "$1=\n")


def document_messages(spark: SparkSession, d: str) -> DataFrame:
    """A raw message per document, with a different shape for each language.

    en: plain and HTML alternatives; de: quoted-printable plain text with a
    plain attachment; fr: one plain 8-bit body with a damaged charset name;
    es: HTML only.
    """
    text = F.col("text")
    html = F.concat(F.lit("<html><body><p>"), text, F.lit("</p></body></html>"))
    escaped = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    shown = F.concat(F.lit("<html><head><style>p{}</style></head><body><!-- x --><p>"), escaped, F.lit("</p></body></html>"))

    def part(kind: str, body: Column, extra: str = "", quoted: bool = False) -> Column:
        way = "quoted-printable" if quoted else "base64"
        head = f'Content-Type: {kind}; charset="utf-8"\nContent-Transfer-Encoding: {way}\n{extra}\n'
        return F.concat(F.lit("--b1\n" + head), _quoted(body) if quoted else _b64(body), F.lit("\n"))

    def multi(kind: str, *parts: Column) -> Column:
        head = f'Content-Type: multipart/{kind}; boundary="b1"\n\n'
        return F.concat(F.lit(head), *parts, F.lit("--b1--\n"))

    body = (
        F.when(F.col("lang") == "en", multi("alternative", part("text/plain", text), part("text/html", html)))
        .when(
            F.col("lang") == "de",
            multi(
                "mixed",
                part("text/plain", text, quoted=True),
                part("text/plain", F.lit("attached"), 'Content-Disposition: attachment; filename="a.txt"\n'),
            ),
        )
        .when(
            F.col("lang") == "fr",
            F.concat(F.lit('Content-Type: text/plain; charset="3Dutf-8"\nContent-Transfer-Encoding: 8bit\n\n'), text),
        )
        .otherwise(
            F.concat(F.lit('Content-Type: text/html; charset="utf-8"\nContent-Transfer-Encoding: base64\n\n'), _b64(shown))
        )
    )
    head = F.lit("From: a@a.example\nTo: b@b.example\nMIME-Version: 1.0\n")
    return spread_table(spark, d, "documents").select(
        F.col("doc_id").alias("msg_id"), "lang", "source", F.concat(head, body).alias("mime")
    )


def _let_sql(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _rotate_sql(x: str, bits: int) -> str:
    return f"((({x} * {1 << bits}) & 4294967295) | ({x} >> {32 - bits}))"


def slot_sql(term: str) -> str:
    """The slot the text models keep a term in: MurmurHash3 of its UTF-8 bytes with seed 42, the last 18 bits."""

    def times(x: str, by: int) -> str:
        return f"(({x} * {by}::UBIGINT) & 4294967295)"

    def mixed(k: str) -> str:
        return times(_let_sql(times(k, 0xCC9E2D51), "k1", _rotate_sql("k1", 15)), 0x1B873593)

    def number(start: str, count: str) -> str:
        """``count`` bytes from byte ``start`` on, the lowest first."""
        byte = f"('0x' || substr(h, 2 * ({start} + j) + 1, 2))::UBIGINT * (1::UBIGINT << (8 * j)::UBIGINT)"
        return f"coalesce(list_sum(list_transform(range({count}), lambda j: {byte})), 0)::UBIGINT"

    step = _let_sql("xor(a, b)", "x", f"(({_rotate_sql('x', 13)} * 5 + 3864292196) & 4294967295)")
    blocks = f"list_transform(range(n // 4), lambda i: {mixed(number('4 * i', '4'))})"
    body = f"list_reduce(list_prepend(42::UBIGINT, {blocks}), lambda a, b: {step})"
    whole = f"xor(xor({body}, {mixed(number('n - n % 4', 'n % 4'))}), n::UBIGINT)"
    first = _let_sql(whole, "f0", times("xor(f0, f0 >> 16)", 0x85EBCA6B))
    second = _let_sql(first, "f1", times("xor(f1, f1 >> 13)", 0xC2B2AE35))
    last = _let_sql(second, "f2", "(xor(f2, f2 >> 16) & 262143)")
    return _let_sql(f"hex({term})", "h", _let_sql("length(h) // 2", "n", last))


BLANKS_SQL = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANKS_SQL}+|{BLANKS_SQL}+$', '', 'g')"


EXTRACTED_SQL = f"""SELECT doc_id AS msg_id, CASE WHEN lang IN ('en', 'es') THEN 'text/html' ELSE 'text/plain' END AS content_type,
  CASE WHEN lang = 'es' THEN {strip_sql('text')} ELSE text END AS email_text,
  CASE lang WHEN 'en' THEN '<html><body><p>' || text || '</p></body></html>'
    WHEN 'es' THEN '<html><head><style>p{{}}</style></head><body><!-- x --><p>'
      || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p></body></html>' ELSE '' END AS html
  FROM documents"""

# Characters a link may hold (fixed values).
_HOST = r"a-zA-Z0-9.=_\-%&"
_LINK = _HOST + "/?#"


def shorten_sql(c: str) -> str:
    pattern = (
        rf"(https?://[{_HOST}]+)[{_LINK}]*|(https?://[/?#][{_LINK}]*)"
        rf"|(www\.[{_HOST}]+)[{_LINK}]*|(www\.)[/?#][{_LINK}]*"
    )
    return rf"regexp_replace({c}, '{pattern}', '\1\2\3\4', 'g')"


def clean_sql(c: str) -> str:
    plain = rf"regexp_replace({c}, '[\x00-\x1F\x7F-\x9F\x{{200c}}\x{{a0}}]', ' ', 'g')"
    return f"trim(regexp_replace({plain}, '{BLANKS_SQL}+', ' ', 'g'))"


def domains_sql(c: str) -> str:
    links = rf"regexp_extract_all({c}, '(https?://[{_LINK}]+|www\.[{_LINK}]+)', 1)"
    hosts = rf"list_transform({links}, lambda x: regexp_extract(x, '^(https?://[{_HOST}]+|www\.[{_HOST}]*)', 1))"
    return f"array_to_string(list_sort(list_distinct(list_filter({hosts}, lambda h: h <> ''))), ' ')"
