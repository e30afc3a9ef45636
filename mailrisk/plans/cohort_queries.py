"""Queries over users, suspensions, countries and review order."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailrisk.functions import text as X
from mailrisk.operators import cohort, geo, language, ranking, rows
from mailrisk.operators.bayes import SLOTS
from mailrisk.plans import jobs
from mailrisk.plans import standins as I
from mailrisk.plans.registry import query, spread_table, table

_WINDOW = f"""SELECT m.user_id, m.msg_id, m.email_date, s.created_at FROM ({I.DATED_SQL}) m
  JOIN ({I.SUSPENDED_SQL}) s ON m.user_id = s.user_id AND m.email_date > s.created_at - INTERVAL 3 DAY"""


@query("active_users", "SELECT user_id, count(*) AS email_count FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id")
def _(spark, d):
    return cohort.active_users(table(spark, d, "events"), I.as_of(), created="ts")


@query(
    "active_users_over",
    """SELECT user_id, count(*) AS email_count FROM events WHERE ts >= TIMESTAMP '2024-01-15'
    GROUP BY user_id HAVING count(*) > 35""",
)
def _(spark, d):
    return cohort.active_users_over(cohort.active_users(table(spark, d, "events"), I.as_of(), created="ts"), 35)


@query("emails_per_user", "SELECT user_id, count(*) AS email_count FROM events GROUP BY user_id")
def _(spark, d):
    return cohort.emails_per_user(table(spark, d, "events"))


@query(
    "latest_per_user",
    "SELECT user_id, max(ts) AS created_at, arg_max(event_id, ts) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id",
)
def _(spark, d):
    notes = table(spark, d, "events").filter("event_type = 'error'")
    return ranking.latest_per_user(notes.select("user_id", F.col("ts").alias("created_at"), "event_id"))


@query(
    "latest_per_user_tied",
    """SELECT o_custkey, o_orderdate, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return ranking.latest_per_user(orders, "o_custkey", "o_orderdate", tie="o_orderkey")


@query(
    "latest_per_key_ranked",
    """SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey) = 1""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    order = [F.desc("o_orderdate"), F.asc("o_orderpriority"), F.asc("o_orderkey")]
    return ranking.latest_per_key_ranked(orders, "o_custkey", *order)


@query(
    "first_record_per_user",
    """SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) = 1""",
)
def _(spark, d):
    df = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return ranking.first_record_per_user(df, "user_id", "event_type", "event_id")


@query(
    "user_email_stats",
    """SELECT c_custkey AS "user", count(o_orderkey) AS email_count FROM customer
    LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
)
def _(spark, d):
    mails = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    return cohort.user_email_stats(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), mails)


@query("suspended_users", I.SUSPENDED_SQL)
def _(spark, d):
    return cohort.suspended_users(I.suspension_notes(spark, d))


def _suspended(spark, d):
    return cohort.suspended_users(I.suspension_notes(spark, d))


@query("join_suspensions", f"SELECT m.*, s.created_at FROM ({I.DATED_SQL}) m JOIN ({I.SUSPENDED_SQL}) s USING (user_id)")
def _(spark, d):
    return cohort.join_suspensions(I.dated_mails(spark, d), _suspended(spark, d))


@query("suspension_window", _WINDOW)
def _(spark, d):
    mails = I.dated_mails(spark, d).drop("event_type")
    return cohort.suspension_window(mails, _suspended(spark, d))


@query("suspension_window_upper", f"SELECT * FROM ({_WINDOW}) WHERE email_date <= created_at")
def _(spark, d):
    mails = I.dated_mails(spark, d).drop("event_type")
    return cohort.suspension_window(mails, _suspended(spark, d), upper=True)


@query("suspension_window_salted", _WINDOW)
def _(spark, d):
    """The way taken when the suspended users are too many to broadcast."""
    mails = I.dated_mails(spark, d).drop("event_type")
    return cohort.suspension_window(mails, _suspended(spark, d), rows=0)


@query("mails_before_suspension", f"SELECT user_id, count(*) AS email_count, max(email_date) AS last_mail FROM ({_WINDOW}) GROUP BY user_id")
def _(spark, d):
    window = cohort.suspension_window(I.dated_mails(spark, d), _suspended(spark, d))
    return window.groupBy("user_id").agg(F.count(F.lit(1)).alias("email_count"), F.max("email_date").alias("last_mail"))


_RECENT = "SELECT user_id, max(ts) AS created_at FROM events WHERE event_type LIKE '%err%' AND ts >= TIMESTAMP '2024-01-15' GROUP BY user_id"


@query("suspended_cohort", _WINDOW.replace(I.SUSPENDED_SQL, _RECENT))
def _(spark, d):
    notes = table(spark, d, "events").withColumnsRenamed({"ts": "created_at", "event_type": "agent_notes"})
    return jobs.suspended_cohort(I.dated_mails(spark, d).drop("event_type"), notes, "err", I.as_of())


def _file_links(spark, d):
    """Stored files exist for the labelled documents; some have an empty id."""
    fid = F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    return table(spark, d, "labels").select(X.html_key(F.col("doc_id").cast("string")).alias("filename"), fid.alias("file_id"))


_LINK = """CASE WHEN l.doc_id IS NULL OR toxic = 1 THEN 'Not Found'
  ELSE '=HYPERLINK("https://drive.google.com/file/d/f' || l.doc_id || '/view", "HTML File")' END"""


@query(
    "attach_file_links",
    f"""SELECT d.doc_id::VARCHAR AS msg_id, d.doc_id || '.html' AS filename, {_LINK} AS "HTML_File_Link"
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _(spark, d):
    mails = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("msg_id"))
    return cohort.attach_file_links(mails, _file_links(spark, d))


@query("count_unmapped", "SELECT count(*) AS unmapped FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    mails = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("msg_id"))
    return cohort.count_unmapped(mails, _file_links(spark, d))


def _mark(code):
    return lambda: lambda texts: [f"[{code}] {t}" for t in texts]


def _sheet_mails(spark, d):
    """Mails whose bodies are the documents, in turn."""
    docs = table(spark, d, "documents").select(
        "doc_id", "lang", F.col("source").alias("subject"), F.col("text").alias("email_text")
    )
    number = F.col("event_id") % docs.count()
    events = table(spark, d, "events").select("event_id", "user_id", "ts", number.alias("doc_id"))
    return events.join(docs, "doc_id").select(
        "user_id",
        F.col("event_id").cast("string").alias("msg_id"),
        F.col("ts").cast("date").cast("timestamp_ntz").alias("email_date"),
        "lang",
        "subject",
        "email_text",
        X.clean_email_text("email_text").alias("cleaned_text"),
        F.lit("text/plain").alias("content_type"),
        F.lit(1).alias("two_label"),
        F.lit(0.5).alias("two_score"),
    )


_FR_MARK = "CASE WHEN d.lang = 'fr' THEN '[fr] ' ELSE '' END"


@query(
    "labeling_sheet",
    f"""SELECT e.user_id, e.event_id::VARCHAR AS msg_id, e.ts::DATE::TIMESTAMP AS email_date, s.created_at,
      d.lang, {_FR_MARK} || d.source AS subject, {_FR_MARK} || {I.clean_sql(I.shorten_sql('d.text'))} AS translated_text, {_LINK} AS "HTML_File_Link"
    FROM events e JOIN ({I.SUSPENDED_SQL}) s ON e.user_id = s.user_id AND e.ts::DATE::TIMESTAMP > s.created_at - INTERVAL 3 DAY
    JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents) LEFT JOIN labels l ON l.doc_id = e.event_id""",
)
def _(spark, d):
    return jobs.labeling_sheet(_sheet_mails(spark, d), _suspended(spark, d), _file_links(spark, d), {"fr": _mark("fr")})


@query(
    "pending_only",
    "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    return cohort.pending_only(orders, orders.filter("o_orderstatus = 'F'"), "o_custkey")


# --- country and language of mails ------------------------------------------------

_IP_MAILS = f"SELECT event_id, {I.IP_SQL} AS originating_ip FROM events"
_IP_NUMBER = " + ".join(
    f"split_part(originating_ip, '.', {i + 1})::BIGINT * {256 ** (3 - i)}" for i in range(4)
)
_PRIVATE = " OR ".join(
    f"ip BETWEEN {geo._number(a)} AND {geo._number(b)}" for a, b in geo.PRIVATE_BLOCKS
)
COUNTRY_SQL = f"""WITH m AS (SELECT *, CASE WHEN originating_ip LIKE '%.%' THEN {_IP_NUMBER} END AS ip FROM ({_IP_MAILS})),
  p AS (SELECT event_id, originating_ip, CASE WHEN NOT ({_PRIVATE}) THEN ip END AS ip FROM m)
  SELECT event_id, originating_ip, CASE WHEN r.start_ip IS NULL THEN 'N/A' ELSE country END AS originating_ip_country
  FROM p LEFT JOIN ({I.RANGES_SQL}) r ON ip BETWEEN r.start_ip AND r.end_ip"""


def _ip_mails(spark, d):
    return table(spark, d, "events").select("event_id", I.ip_of_event().alias("originating_ip"))


@query("ip_country", COUNTRY_SQL)
def _(spark, d):
    return geo.ip_country(_ip_mails(spark, d), I.nation_ranges(spark, d), spread="event_id")


@query("ip_country_salted", COUNTRY_SQL)
def _(spark, d):
    """The way taken when the range table is too large to broadcast."""
    return geo.ip_country(_ip_mails(spark, d), I.nation_ranges(spark, d), spread="event_id", rows=0, salts=4)


@query(
    "ip_country_v6",
    """SELECT event_id, CASE WHEN event_type = 'error' OR k IS NULL THEN 'N/A' ELSE n_name END AS originating_ip_country
    FROM events LEFT JOIN (SELECT n_nationkey::BIGINT AS k, n_name FROM nation) ON user_id BETWEEN k * 6 AND k * 6 + 4""",
)
def _(spark, d):
    """The user is the third group of the address; each nation owns five of every six."""
    group = F.lower(F.hex("user_id"))
    address = F.concat(F.lit("2001:DB8:"), group, F.lit("::"), F.hex(F.col("event_id") % 65536))
    address = F.when(F.col("event_type") == "error", F.lit("2001:db8::1::2")).otherwise(address)
    mails = table(spark, d, "events").select("event_id", address.alias("originating_ip"))
    key = F.col("n_nationkey").cast("bigint") * 6

    def edge(user, fill):
        return F.concat(F.lit("20010db8"), F.lower(F.lpad(F.hex(user), 4, "0")), F.lit(fill * 20))

    ranges6 = table(spark, d, "nation").select(
        edge(key, "0").alias("start_ip"), edge(key + 4, "f").alias("end_ip"), F.col("n_name").alias("country")
    )
    out = geo.ip_country(mails, I.nation_ranges(spark, d), ranges6, spread="event_id")
    return out.drop("originating_ip")


# Networks in networks: a nation's first octet, in it those of suppliers (16 bits) and of customers (24 and 28 bits).
_NETWORKS = """SELECT (n_nationkey::BIGINT + 1) * 16777216 AS start, 8 AS bits, n_name AS country FROM nation WHERE n_nationkey % 5 <> 4
  UNION ALL SELECT (s_suppkey::BIGINT % 40) * 16777216 + (s_suppkey::BIGINT % 256) * 65536, 16, CASE WHEN s_suppkey % 9 > 0 THEN 'S' || s_nationkey END FROM supplier
  UNION ALL SELECT (c_custkey::BIGINT % 40) * 16777216 + (c_custkey::BIGINT % 256) * 65536 + (c_custkey::BIGINT % 250) * 256, 24, 'C' || c_nationkey FROM customer
  UNION ALL SELECT (c_custkey::BIGINT % 60) * 16777216 + (c_custkey::BIGINT * 3 % 256) * 65536 + (c_custkey::BIGINT % 250) * 256 + 240, 28, 'D' || c_nationkey FROM customer"""


def _networks(spark, d):
    def written(name, key, octets, bits, country):
        k = F.col(key).cast("bigint")
        text = F.concat_ws(".", *[o(k).cast("string") for o in octets])
        return table(spark, d, name).select(F.concat(text, F.lit(f"/{bits}")).alias("network"), country.alias("country"))

    def zero(k):
        return F.lit(0)

    nation = written("nation", "n_nationkey", [lambda k: k + 1, zero, zero, lambda k: F.lit(9)], 8, F.col("n_name"))
    nation = nation.join(table(spark, d, "nation").filter("n_nationkey % 5 <> 4").select(F.col("n_name").alias("country")), "country")
    wide = F.when(F.col("s_suppkey") % 9 > 0, F.concat(F.lit("S"), F.col("s_nationkey").cast("string")))
    supplier = written("supplier", "s_suppkey", [lambda k: k % 40, lambda k: k % 256, lambda k: F.lit(7), zero], 16, wide)
    of = [F.concat(F.lit(x), F.col("c_nationkey").cast("string")) for x in "CD"]
    customer = written("customer", "c_custkey", [lambda k: k % 40, lambda k: k % 256, lambda k: k % 250, lambda k: F.lit(1)], 24, of[0])
    narrow = written("customer", "c_custkey", [lambda k: k % 60, lambda k: k * 3 % 256, lambda k: k % 250, lambda k: F.lit(255)], 28, of[1])
    return nation.select("network", "country").union(supplier).union(customer).union(narrow)


@query(
    "ip_country_nested",
    f"""WITH n AS (SELECT start, bits, min(country) AS country FROM ({_NETWORKS}) GROUP BY ALL),
    m AS (SELECT *, CASE WHEN originating_ip LIKE '%.%' THEN {_IP_NUMBER} END AS ip FROM ({_IP_MAILS})),
    p AS (SELECT event_id, originating_ip, CASE WHEN NOT ({_PRIVATE}) THEN ip END AS ip FROM m)
    SELECT event_id, originating_ip, CASE WHEN d.bits > 0 THEN d.country WHEN c.bits > 0 THEN c.country
      WHEN b.bits > 0 THEN b.country WHEN a.bits > 0 THEN a.country ELSE 'N/A' END AS originating_ip_country
    FROM p LEFT JOIN n a ON a.bits = 8 AND a.start = ip - ip % 16777216 LEFT JOIN n b ON b.bits = 16 AND b.start = ip - ip % 65536
    LEFT JOIN n c ON c.bits = 24 AND c.start = ip - ip % 256 LEFT JOIN n d ON d.bits = 28 AND d.start = ip - ip % 16""",
)
def _(spark, d):
    """The narrowest network around an address counts."""
    v4, _v6 = geo.cidr_ranges(_networks(spark, d))
    return geo.ip_country(_ip_mails(spark, d), v4, spread="event_id", nested=True)


@query(
    "overlapping_ranges",
    f"""SELECT DISTINCT b.start_ip, b.end_ip, b.country FROM (SELECT start_ip, end_ip + 20000000 AS end_ip, country FROM ({I.RANGES_SQL})) a
    JOIN (SELECT start_ip, end_ip + 20000000 AS end_ip, country FROM ({I.RANGES_SQL})) b ON b.start_ip > a.start_ip AND b.start_ip <= a.end_ip""",
)
def _(spark, d):
    wide = I.nation_ranges(spark, d).withColumn("end_ip", F.col("end_ip") + 20000000)
    return geo.overlapping_ranges(wide)


@query(
    "route_by_language",
    "SELECT doc_id, lang, CASE WHEN lang IN ('fr', 'de') THEN 'translate' ELSE 'keep' END AS route FROM (SELECT doc_id, lang || '-xx' AS lang FROM documents) t".replace("lang IN", "split_part(lang, '-', 1) IN"),
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("-xx")).alias("lang"))
    return language.route_by_language(docs, ["fr", "de"])


def _fails_on_short(texts):
    if any(len(t) < 500 for t in texts):
        raise ValueError("too short")
    return [f"[de] {t}" for t in texts]


@query(
    "translate",
    """SELECT doc_id, CASE WHEN lang = 'fr' THEN '[fr] ' || text WHEN lang = 'de' AND length(text) >= 500 THEN '[de] ' || text
    ELSE text END AS translated_text FROM documents""",
)
def _(spark, d):
    docs = spread_table(spark, d, "documents").select("doc_id", "lang", "text")
    out = language.translate(docs, {"fr": _mark("fr"), "de": lambda: _fails_on_short}, {"text": "translated_text"})
    return out.select("doc_id", "translated_text")


# Multinomial naive Bayes on hashed character trigrams, add-one smoothing, fitted on all documents.
_LETTERS = r"string_split_regex(lower(text), '[^\p{L}]+')"


def language_sql(texts: str) -> str:
    """(id, detected) of the rows (id, text) of ``texts``."""

    def grams(source: str) -> str:
        return f"""SELECT * EXCLUDE (word), unnest(list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i::INT, 3))) AS gram
          FROM (SELECT * EXCLUDE (text), unnest(list_filter({_LETTERS}, lambda x: x <> '')) AS word FROM ({source}))"""

    return f"""WITH rl AS (SELECT lang, gram, count(*) AS n FROM ({grams('SELECT lang, text FROM documents')}) GROUP BY ALL),
  x AS ({texts}),
  rx AS (SELECT id, gram, count(*) AS n FROM ({grams('SELECT * FROM x')}) GROUP BY ALL),
  gs AS MATERIALIZED (SELECT gram, {I.slot_sql('gram')} AS slot FROM (SELECT gram FROM rl UNION SELECT gram FROM rx)),
  lg AS (SELECT lang, slot, sum(n) AS n FROM rl JOIN gs USING (gram) GROUP BY ALL),
  tot AS (SELECT lang, sum(n) AS total FROM lg GROUP BY lang),
  pri AS (SELECT lang, ln(count(*) + 1.0) - ln(sum(count(*)) OVER () + count(*) OVER ()) AS pi FROM documents GROUP BY lang),
  dg AS (SELECT id, slot, sum(n) AS n FROM rx JOIN gs USING (gram) GROUP BY ALL),
  hit AS (SELECT id, lang, sum(dg.n * ln(lg.n + 1.0)) AS s FROM dg JOIN lg USING (slot) GROUP BY ALL),
  len AS (SELECT x.id, coalesce(sum(n), 0) AS n FROM x LEFT JOIN dg USING (id) WHERE regexp_matches(text, '\\p{{L}}') GROUP BY x.id),
  sc AS (SELECT len.id, tot.lang, pi + coalesce(hit.s, 0) - len.n * ln(total + {SLOTS}.0) AS score
    FROM len CROSS JOIN tot JOIN pri USING (lang) LEFT JOIN hit ON hit.id = len.id AND hit.lang = tot.lang)
  SELECT x.id, coalesce(arg_max(lang, score), 'N/A') AS detected FROM x LEFT JOIN sc USING (id) GROUP BY x.id"""


_LANG = f"SELECT doc_id, lang, detected FROM documents JOIN ({language_sql('SELECT doc_id AS id, text FROM documents')}) ON id = doc_id"


@query("detect_language", _LANG)
def _(spark, d):
    docs = spread_table(spark, d, "documents").select("doc_id", "lang", "text")
    model = language.fit_language(docs)
    return language.detect_language(docs, model, "text", "detected").drop("text")


# --- ranked rows ------------------------------------------------------------------


@query(
    "top_n_per_dataset",
    f"""SELECT dataset, msg_id, two_score FROM ({I.SCORED_SQL})
    QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY two_score DESC, msg_id) <= 50""",
)
def _(spark, d):
    df = I.scored_mails(spark, d).select("dataset", "msg_id", "two_score")
    return ranking.top_n_per_dataset(df, 50, "two_score")


@query("top_n", f"SELECT msg_id, two_score FROM ({I.SCORED_SQL}) ORDER BY two_score DESC, msg_id LIMIT 50")
def _(spark, d):
    return ranking.top_n(I.scored_mails(spark, d).select("msg_id", "two_score"), 50, "two_score", "msg_id")


@query("sort_by_score", f"SELECT msg_id, dataset, two_score FROM ({I.SCORED_SQL}) ORDER BY two_score DESC, msg_id")
def _(spark, d):
    return ranking.sort_by_score(I.scored_mails(spark, d).select("msg_id", "dataset", "two_score"), "two_score", "msg_id")


# Review columns made from the number of a mail, in SQL.
_REVIEWED = {
    "user_id": "msg_id % 150",
    "sg_event_id": "lpad(msg_id::VARCHAR, 12, '0')",
    "subject": "'s' || msg_id",
    "email_from": "'from' || (msg_id % 150) || '@a.example'",
    "email_to": "'to' || msg_id || '@b.example'",
    "email_date": "'2024-01-0' || (msg_id % 9 + 1)",
    "originating_ip": "'1.2.3.' || (msg_id % 250)",
    "originating_ip_country": "'C' || (msg_id % 7)",
    "lang": "CASE WHEN msg_id % 4 = 0 THEN 'fr' ELSE 'en' END",
    "content_type": "CASE WHEN msg_id % 3 = 0 THEN 'text/html' ELSE 'text/plain' END",
    "translated_text": "'t' || msg_id",
}


@query(
    "review_sample",
    f"""SELECT msg_id, dataset, two_score, {', '.join(f'{v} AS {k}' for k, v in _REVIEWED.items())}
    FROM ({I.SCORED_SQL}) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY two_score DESC, msg_id) <= 50""",
)
def _(spark, d):
    columns = {k: F.expr(v.replace("msg_id::VARCHAR", "cast(msg_id AS string)")) for k, v in _REVIEWED.items()}
    mails = I.scored_mails(spark, d).withColumns(columns)
    frames = {name: mails.filter(F.col("dataset") == name).drop("dataset") for name in ("Suspended User", "Good User")}
    return jobs.review_sample(frames, "two_score")


@query(
    "sample_n",
    f"""SELECT id, dataset FROM ({I.SETS_SQL}) WHERE dataset IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5(id || '/42'), id) <= 100""",
)
def _(spark, d):
    sets = I.embedding_sets(spark, d).select("id", "dataset")
    return ranking.sample_n(sets, 100, "dataset", "id")


@query(
    "sample_n_sizes",
    f"SELECT dataset, least(100, count(*)) AS n, least(100, count(*)) AS n_ids, 0::BIGINT AS n_foreign FROM ({I.SETS_SQL}) GROUP BY dataset",
)
def _(spark, d):
    sets = I.embedding_sets(spark, d).select("id", "dataset")
    picked = ranking.sample_n(sets, 100, "dataset", "id")
    checked = picked.join(sets.withColumn("known", F.lit(1)), ["id", "dataset"], "left")
    return checked.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id").alias("n_ids"),
        F.count_if(F.col("known").isNull()).alias("n_foreign"),
    )
