"""Queries over text, scores, answers, reports and embedding sets."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailrisk.functions import scores as C
from mailrisk.functions import text as X
from mailrisk.functions import vectors as V
from mailrisk.operators import embeddings as E
from mailrisk.operators import report, scoring
from mailrisk.operators.bayes import SLOTS
from mailrisk.operators.joins import lookup_join
from mailrisk.plans import jobs
from mailrisk.plans import standins as I
from mailrisk.plans.registry import query, spread_table, table

# --- text ------------------------------------------------------------------------

_TEXTS = "SELECT 'd' || doc_id AS id, text AS t FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages UNION ALL SELECT 'u' || page_id, url FROM pages"


def _texts(spark, d):
    pages = spread_table(spark, d, "pages")
    docs = spread_table(spark, d, "documents")

    def rows(df, letter, key, text):
        return df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.col(text).alias("t"))

    return rows(docs, "d", "doc_id", "text").union(rows(pages, "p", "page_id", "html")).union(rows(pages, "u", "page_id", "url"))


@query("clean_basic", f"SELECT id, {I.clean_sql('t')} AS cleaned FROM ({_TEXTS})")
def _(spark, d):
    return _texts(spark, d).select("id", X.clean_basic("t").alias("cleaned"))


@query("clean_email_text", f"SELECT id, {I.clean_sql(I.shorten_sql('t'))} AS cleaned FROM ({_TEXTS})")
def _(spark, d):
    return _texts(spark, d).select("id", X.clean_email_text("t").alias("cleaned"))


@query("url_domains", f"SELECT id, {I.domains_sql('t')} AS domains FROM ({_TEXTS})")
def _(spark, d):
    return _texts(spark, d).select("id", X.url_domains("t").alias("domains"))


@query(
    "subject_body",
    f"""SELECT doc_id, {I.strip_sql("coalesce(CASE WHEN lang <> 'en' THEN source END, '') || ' ' || coalesce(text, '')")} AS subject_body FROM documents""",
)
def _(spark, d):
    subject = F.when(F.col("lang") != "en", F.col("source"))
    return table(spark, d, "documents").select("doc_id", X.subject_body(subject, "text").alias("subject_body"))


@query("base_lang", "SELECT doc_id, lang AS base FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.base_lang(F.concat("lang", F.lit("-"), "source")).alias("base"))


@query(
    "normalise_charset",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'utf-8' WHEN 'fr' THEN 'iso-8859-1' WHEN 'de' THEN 'utf-8' ELSE 'windows-1252' END AS charset FROM documents",
)
def _(spark, d):
    raw = (
        F.when(F.col("lang") == "en", F.lit(" 3DUTF-8"))
        .when(F.col("lang") == "fr", F.lit("=ISO-8859-1\n"))
        .when(F.col("lang") == "es", F.lit("Windows-1252"))
    )
    return table(spark, d, "documents").select("doc_id", X.normalise_charset(raw).alias("charset"))


@query(
    "path_parts",
    "SELECT page_id, regexp_extract(url, '[^/]*$') AS file_name, page_id::VARCHAR AS user_id FROM pages",
)
def _(spark, d):
    path = F.concat(F.lit("store/users/"), F.col("page_id").cast("string"), F.lit("/a.json"))
    return table(spark, d, "pages").select("page_id", X.file_name("url").alias("file_name"), X.user_from_path(path).alias("user_id"))


# --- prompts and answers ---------------------------------------------------------

_MARK = C.ANSWER_MARK
_ANSWER = """CASE role WHEN 'user' THEN '  TRUE' WHEN 'assistant' THEN 'it is False, true' ELSE 'none' END"""
_RESPONSE = "upper(replace(text, ' ', '')) || CASE WHEN turn = 0 THEN 'TRUEfalse xTRUE TRUE' ELSE 'FALSETRUEFALSE FALSETRUETRUE' END"


def _outputs(spark, d):
    talks = table(spark, d, "conversations")
    answer = F.when(F.col("role") == "user", F.lit("  TRUE")).when(F.col("role") == "assistant", F.lit("it is False, true"))
    output = F.concat(C.build_prompt("text"), F.coalesce(answer, F.lit("none")), F.lit(" \n"))
    return talks.select("conv_id", "turn", "text", output.alias("output"))


@query("build_prompt", f"SELECT conv_id, turn, 'Classify as phishing (TRUE) or not (FALSE):' || chr(10) || text || chr(10) || '{_MARK}' AS prompt FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", C.build_prompt("text").alias("prompt"))


@query(
    "prompt_answer_flags",
    f"""SELECT conv_id, turn, trim({_ANSWER}) AS answer, trim({_ANSWER}) AS first_answer,
    CASE role WHEN 'user' THEN 1 ELSE 0 END AS flag FROM conversations""",
)
def _(spark, d):
    answer = C.extract_answer("output")
    return _outputs(spark, d).select(
        "conv_id", "turn", answer.alias("answer"), C.extract_first_answer("output").alias("first_answer"),
        C.parse_boolean(answer).alias("flag"),
    )


@query(
    "majority_vote",
    f"""SELECT conv_id, turn, CASE WHEN len(list_filter(list_slice(regexp_extract_all(upper(replace({_RESPONSE}, ' ', '')), 'TRUE|FALSE'), 1, 5),
    lambda v: v = 'TRUE')) >= 3 THEN 1 ELSE 0 END AS vote FROM conversations""",
)
def _(spark, d):
    marks = F.when(F.col("turn") == 0, F.lit("TRUEfalse xTRUE TRUE")).otherwise(F.lit("FALSETRUEFALSE FALSETRUETRUE"))
    response = F.concat(F.upper(F.replace("text", F.lit(" "), F.lit(""))), marks)
    return table(spark, d, "conversations").select("conv_id", "turn", C.majority_vote(response).alias("vote"))


# --- scores ----------------------------------------------------------------------


@query("softmax", f"SELECT vec_id, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2, round(p[4], 6) AS p3, list_position(p, list_max(p)) - 1 AS best FROM (SELECT vec_id, {I._softmax_sql(3, 4)} AS p FROM embeddings)")
def _(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", C.softmax(I.logits(3, 4)).alias("p"))
    return df.select("vec_id", *[C.round6(F.col("p")[i]).alias(f"p{i}") for i in range(4)], C.argmax("p").alias("best"))


for _model in I.MODELS:

    @query(
        {"two": "score_two_class", "four": "score_four_class", "named": "score_named"}[_model],
        f"SELECT msg_id, {_model}_label, {_model}_score FROM ({I.SCORED_SQL})",
    )
    def _(spark, d, _model=_model):
        return I.scored_mails(spark, d).select("msg_id", f"{_model}_label", f"{_model}_score")


def _two_logits():
    """Stand-in for a model outside Spark: logits from counts of two letters."""

    def predict(texts: np.ndarray) -> np.ndarray:
        flat = [str(t) for t in texts.reshape(-1)]
        return np.array([[t.count("e") / 100.0, t.count("a") / 100.0] for t in flat])

    return predict


@query(
    "batch_model_call",
    """SELECT doc_id, (a > e)::INT AS ext_label, round(CASE WHEN a > e THEN 1 / (1 + exp((e - a) / 100.0))
      ELSE 1 - 1 / (1 + exp((a - e) / 100.0)) END, 6) AS ext_score
    FROM (SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS e, length(text) - length(replace(text, 'a', '')) AS a FROM documents)""",
)
def _(spark, d):
    model = scoring.external_model("ext", "text", _two_logits)
    return scoring.classify_text(spread_table(spark, d, "documents").select("doc_id", "text"), model).drop("text")


def bayes_sql(train: str, texts: str) -> str:
    """(id, label, score) of the rows (id, text) of ``texts``.

    Multinomial naive Bayes on hashed words with add-one smoothing, fitted on
    the rows (y, text) of ``train`` with y 0 or 1.
    """

    def words(source: str) -> str:
        return rf"""SELECT * EXCLUDE (text), unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}]+'), lambda x: x <> '')) AS word FROM ({source})"""

    return f"""WITH t AS ({train}), x AS ({texts}),
  rw AS (SELECT y, word, count(*) AS n FROM ({words('SELECT * FROM t')}) GROUP BY ALL),
  rx AS (SELECT id, word, count(*) AS n FROM ({words('SELECT * FROM x')}) GROUP BY ALL),
  ws AS MATERIALIZED (SELECT word, {I.slot_sql('word')} AS slot FROM (SELECT word FROM rw UNION SELECT word FROM rx)),
  tw AS (SELECT y, slot, sum(n) AS n FROM rw JOIN ws USING (word) GROUP BY ALL),
  tot AS (SELECT y, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT y FROM t) LEFT JOIN tw USING (y) GROUP BY y),
  pri AS (SELECT y, ln(count(*) + 1.0) - ln(sum(count(*)) OVER () + count(*) OVER ()) AS pi FROM t GROUP BY y),
  xw AS (SELECT id, slot, sum(n) AS n FROM rx JOIN ws USING (word) GROUP BY ALL),
  len AS (SELECT id, sum(n) AS n FROM xw GROUP BY id),
  hit AS (SELECT id, y, sum(xw.n * ln(tw.n + 1.0)) AS s FROM xw JOIN tw USING (slot) GROUP BY ALL),
  sc AS (SELECT x.id, tot.y, pi + coalesce(s, 0) - coalesce(len.n, 0) * ln(total + {SLOTS}.0) AS s
    FROM x CROSS JOIN tot JOIN pri USING (y) LEFT JOIN len ON len.id = x.id LEFT JOIN hit ON hit.id = x.id AND hit.y = tot.y),
  p AS (SELECT id, max(CASE WHEN y = 1 THEN s END) - max(CASE WHEN y = 0 THEN s END) AS z FROM sc GROUP BY id)
  SELECT id, CASE WHEN z > 0 THEN 1 ELSE 0 END AS label, round(CASE WHEN z > 0 THEN 1 / (1 + exp(-z)) ELSE 1 - 1 / (1 + exp(z)) END, 6) AS score FROM p"""


_BAYES = f"""SELECT id AS doc_id, label AS words_label, score AS words_score
  FROM ({bayes_sql('SELECT toxic AS y, text FROM documents JOIN labels USING (doc_id)', 'SELECT doc_id AS id, text FROM documents')})"""


def _labelled(spark, d):
    return spread_table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", "toxic")


@query("classify_text", _BAYES)
def _(spark, d):
    model = scoring.bayes_model("words", _labelled(spark, d), "text", "toxic")
    return scoring.classify_text(spread_table(spark, d, "documents").select("doc_id", "text"), model).drop("text")


@query(
    "classify_text_logistic",
    "SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids, 0::BIGINT AS n_odd_label, 0::BIGINT AS n_odd_score, 0::BIGINT AS n_disagree FROM documents",
)
def _(spark, d):
    """Weights come from an iteration, so what every row must satisfy is counted."""
    model = scoring.logistic_model("lr", _labelled(spark, d), "text", "toxic")
    out = scoring.classify_text(spread_table(spark, d, "documents").select("doc_id", "text"), model)
    return out.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("doc_id").alias("n_ids"),
        F.count_if(~F.coalesce(F.col("lr_label").isin(0, 1), F.lit(False))).alias("n_odd_label"),
        F.count_if(~F.coalesce(F.col("lr_score").between(0, 1), F.lit(False))).alias("n_odd_score"),
        F.count_if((F.col("lr_label") == 1) & (F.col("lr_score") < 0.5) | (F.col("lr_label") == 0) & (F.col("lr_score") > 0.5)).alias("n_disagree"),
    )


# --- reports ---------------------------------------------------------------------

_BY = ["dataset", "model"]


def _long(spark, d):
    return report.long_scores(I.scored_mails(spark, d), I.MODELS, ["msg_id", "dataset"])


@query("value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, d):
    return report.value_counts(table(spark, d, "documents"), "lang")


@query("value_counts_domains", f"SELECT domains, count(*) AS n FROM (SELECT {I.domains_sql('url')} AS domains FROM pages) GROUP BY domains")
def _(spark, d):
    return report.value_counts(table(spark, d, "pages").select(X.url_domains("url").alias("domains")), "domains")


@query("value_counts_above", f"SELECT dataset, model, label, count(*) AS n FROM ({I.LONG_SQL}) WHERE score >= 0.99 GROUP BY ALL")
def _(spark, d):
    return report.value_counts_above(_long(spark, d), *_BY, "label")


@query(
    "flag_share",
    f"""SELECT dataset, model, count(*) AS n_rows, count(*) FILTER (label = 1 AND score >= 0.99) AS n_flagged,
    round(100.0::DOUBLE * count(*) FILTER (label = 1 AND score >= 0.99) / count(*), 6) AS share FROM ({I.LONG_SQL}) GROUP BY ALL""",
)
def _(spark, d):
    return report.flag_share(_long(spark, d), _BY).withColumn("share", C.round6("share"))


def _histogram_sql(where: str) -> str:
    return f"""WITH x AS (SELECT dataset, model, score FROM ({I.LONG_SQL}) WHERE {where}),
    e AS (SELECT dataset, model, CASE WHEN min(score) = max(score) THEN min(score) - 0.5 ELSE min(score) END AS lo,
      CASE WHEN min(score) = max(score) THEN max(score) + 0.5 ELSE max(score) END AS hi FROM x GROUP BY ALL),
    b AS (SELECT dataset, model, least(floor((score - lo) * 50 / (hi - lo)), 49)::BIGINT + 1 AS bin, count(*) AS n FROM x JOIN e USING (dataset, model) GROUP BY ALL),
    g AS (SELECT *, unnest(range(1, 51)) AS bin FROM e)
    SELECT dataset, model, bin, round(lo + (bin - 1) * ((hi - lo) / 50), 3) AS bin_start, coalesce(n, 0) AS n FROM g LEFT JOIN b USING (dataset, model, bin)"""


@query("score_histogram", _histogram_sql("true"))
def _(spark, d):
    return report.score_histogram(_long(spark, d), _BY).withColumn("bin_start", F.round("bin_start", 3))


@query("score_histogram_above", _histogram_sql("score >= 0.99"))
def _(spark, d):
    return report.score_histogram(_long(spark, d), _BY, threshold=0.99).withColumn("bin_start", F.round("bin_start", 3))


_FIGURES = """count(*) AS n_rows, count(*) FILTER (label = 1) AS n_phish, count(*) FILTER (label = 0) AS n_legit,
    count(*) FILTER (label = 1 AND score >= 0.99) AS n_phish_above, count(*) FILTER (label = 0 AND score >= 0.99) AS n_legit_above,
    round(100.0::DOUBLE * count(*) FILTER (label = 1 AND score >= 0.99) / count(*), 6) AS share,
    min(score) AS min_score, max(score) AS max_score, round(avg(score), 6) AS mean_score"""


@query("model_report", f"SELECT dataset, model, {_FIGURES} FROM ({I.LONG_SQL}) GROUP BY ALL")
def _(spark, d):
    out = report.model_report(_long(spark, d), _BY)
    return out.withColumns({"share": C.round6("share"), "mean_score": C.round6("mean_score")})


# Documents as mails, each with the link of the page of its number at the end; in two data sets by turns.
_LINKED = """SELECT doc_id AS id, text || ' ' || coalesce(url, '') AS body, toxic, quality,
  CASE WHEN doc_id % 2 = 0 THEN 'Suspended User' ELSE 'Good User' END AS dataset
  FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN pages ON page_id = doc_id"""
# model: what it learns from, and what
_TRAINED = {"words": ("body", "toxic"), "worth": ("body", "quality"), "links": (I.domains_sql("body"), "quality")}
_INPUTS = {"text": "body", "url": I.domains_sql("body")}


def _reported_sql() -> str:
    parts = []
    for model, (source, label) in _TRAINED.items():
        train = f"SELECT {label} AS y, {source} AS text FROM ({_LINKED}) WHERE {label} IS NOT NULL"
        for kind, read in _INPUTS.items():
            scored = bayes_sql(train, f"SELECT id, {read} AS text FROM ({_LINKED})")
            parts.append(f"SELECT id, '{kind}' AS input, '{model}' AS model, label, score FROM ({scored})")
    return " UNION ALL ".join(parts)


def _bins_sql(name: str, where: str) -> str:
    """Counts of the 50 bins of each group, in order, as text."""
    return f"""(WITH r AS (SELECT * FROM x WHERE {where}),
      e AS (SELECT dataset, input, model, CASE WHEN min(score) = max(score) THEN min(score) - 0.5 ELSE min(score) END AS lo,
        CASE WHEN min(score) = max(score) THEN max(score) + 0.5 ELSE max(score) END AS hi FROM r GROUP BY ALL),
      b AS (SELECT dataset, input, model, least(floor((score - lo) * 50 / (hi - lo)), 49)::BIGINT + 1 AS bin, count(*) AS n
        FROM r JOIN e USING (dataset, input, model) GROUP BY ALL),
      g AS (SELECT dataset, input, model, unnest(range(1, 51)) AS bin FROM e)
      SELECT dataset, input, model, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY bin) AS {name}
      FROM g LEFT JOIN b USING (dataset, input, model, bin) GROUP BY ALL)"""


@query(
    "score_report",
    f"""WITH x AS (SELECT dataset, input, model, label, score FROM ({_reported_sql()}) JOIN (SELECT id, dataset FROM ({_LINKED})) USING (id)),
    f AS (SELECT dataset, input, model, {_FIGURES} FROM x GROUP BY ALL)
    SELECT f.*, h.histogram, a.histogram_above FROM f LEFT JOIN {_bins_sql('histogram', 'true')} h USING (dataset, input, model)
    LEFT JOIN {_bins_sql('histogram_above', 'score >= 0.99')} a USING (dataset, input, model)""",
)
def _(spark, d):
    """Three models on the texts and on the link domains of two data sets."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    docs = spread_table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").join(pages, "doc_id", "left")
    mails = docs.select("doc_id", F.concat("text", F.lit(" "), F.coalesce("url", F.lit(""))).alias("body"), "toxic", "quality")
    mails = mails.withColumn("domains", X.url_domains("body"))
    columns = {"text": "body", "url": "domains"}
    learned = {"words": ("body", "toxic"), "worth": ("body", "quality"), "links": ("domains", "quality")}
    fitted = {name: scoring.bayes_model(name, mails, *how) for name, how in learned.items()}
    frames = {}
    for kind, column in columns.items():
        models = [replace(m, text_col=column) for m in fitted.values()]
        for i, name in enumerate(("Suspended User", "Good User")):
            half = mails.filter(F.col("doc_id") % 2 == i).select(column)
            frames[name, kind] = scoring.score_all(half, models).drop(column)
    out = jobs.score_report(frames, list(fitted), histograms=True)
    joined = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("histogram", "histogram_above")}
    return out.withColumns({"share": C.round6("share"), "mean_score": C.round6("mean_score"), **joined})


# --- embedding sets --------------------------------------------------------------

_PAIRS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in I.SET_PAIRS) + ") p(set_a, set_b)"
_CENTROIDS = f"""SELECT dataset, list(m ORDER BY pos) AS c FROM (SELECT dataset, pos, avg(x) AS m
  FROM (SELECT dataset, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM ({I.SETS_SQL})) GROUP BY ALL) GROUP BY dataset"""


def _values(df, key, vector):
    """One row per vector position, for comparison."""
    out = df.select(key, F.posexplode(vector).alias("pos", "x"))
    return out.select(key, (F.col("pos") + 1).alias("pos"), F.round("x", 6).alias("x"))


@query("centroid", f"SELECT dataset, generate_subscripts(c, 1)::INT AS pos, round(unnest(c), 6) AS x FROM ({_CENTROIDS})")
def _(spark, d):
    return _values(E.centroid(I.embedding_sets(spark, d)), "dataset", "centroid")


_SIMILARITY = f"""SELECT set_a, set_b, list_cosine_similarity(a.c, b.c) AS similarity FROM {_PAIRS_SQL}
  JOIN ({_CENTROIDS}) a ON a.dataset = set_a JOIN ({_CENTROIDS}) b ON b.dataset = set_b"""


@query("centroid_similarity", f"SELECT set_a, set_b, round(similarity, 6) AS similarity FROM ({_SIMILARITY})")
def _(spark, d):
    out = E.centroid_similarity(I.embedding_sets(spark, d), I.SET_PAIRS)
    return out.withColumn("similarity", C.round6("similarity"))


@query(
    "mean_pairwise_distance",
    f"""SELECT set_a, set_b, round(avg(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS distance FROM {_PAIRS_SQL}
    JOIN ({I.SETS_SQL}) a ON a.dataset = set_a JOIN ({I.SETS_SQL}) b ON b.dataset = set_b GROUP BY ALL""",
)
def _(spark, d):
    out = E.mean_pairwise_distance(I.embedding_sets(spark, d), I.SET_PAIRS)
    return out.withColumn("distance", C.round6("distance"))


@query(
    "closer_set",
    f"""SELECT 'phish' AS set_name, round(a, 6) AS sim_first, round(b, 6) AS sim_second, CASE WHEN a > b THEN 'phish-users' ELSE 'good-users' END AS closer
    FROM (SELECT max(similarity) FILTER (set_b = 'phish-users') AS a, max(similarity) FILTER (set_b = 'good-users') AS b FROM ({_SIMILARITY}) WHERE set_a = 'phish')""",
)
def _(spark, d):
    sims = E.centroid_similarity(I.embedding_sets(spark, d), I.SET_PAIRS)
    out = E.nearest_set(sims, "phish", "phish-users", "good-users")
    return out.withColumns({c: C.round6(c) for c in ("sim_first", "sim_second")})


@query(
    "cosine_to_label_centroid",
    f"""SELECT vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.c), 6) AS similarity,
    round(1 - list_cosine_similarity(e.embedding::DOUBLE[], c.c), 6) AS distance
    FROM embeddings e JOIN (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m
      FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label) c USING (label)""",
)
def _(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    both = lookup_join(df, E.centroid(df, "label"), "label", spread="vec_id", how="inner")
    return both.select(
        "vec_id",
        C.round6(V.cosine_similarity("embedding", "centroid")).alias("similarity"),
        C.round6(V.cosine_distance("embedding", "centroid")).alias("distance"),
    )


def _tokens(spark, d):
    """Every vector is a token of the document its label names, in the order of ids; the first value's sign is the mask."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, d, "embeddings").select(
        F.col("label").alias("doc"),
        place.alias("pos"),
        (F.col("embedding")[0] >= 0).cast("int").alias("mask"),
        F.col("embedding").alias("vec"),
    )


@query(
    "mean_pool",
    """SELECT doc, pos, round(avg(x), 6) AS x FROM (SELECT label AS doc, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1)::INT AS pos
    FROM embeddings WHERE embedding[1] >= 0) GROUP BY ALL""",
)
def _(spark, d):
    return _values(E.mean_pool(_tokens(spark, d)), "doc", "embedding")


@query(
    "first_token_pool",
    """SELECT doc, generate_subscripts(e, 1)::INT AS pos, round(unnest(e)::DOUBLE, 6) AS x FROM (SELECT label AS doc, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label)""",
)
def _(spark, d):
    pooled = E.first_token_pool(_tokens(spark, d))
    return _values(pooled.withColumn("embedding", F.col("embedding").cast("array<double>")), "doc", "embedding")


@query(
    "pca_kmeans",
    f"SELECT count(*) AS n, 0.0::DOUBLE AS sum_x, 0.0::DOUBLE AS sum_y, 0.0::DOUBLE AS sum_xy, 0::BIGINT AS n_far FROM ({I.SETS_SQL})",
)
def _(spark, d):
    """What holds whatever the signs of the axes and the numbers of the clusters: the plane is centred, its
    axes are uncorrelated, and no row is nearer to another centre than to its own."""
    points, centres = E.pca_kmeans(I.embedding_sets(spark, d))
    own = F.col("centres")[F.col("cluster")]
    every = F.transform(F.map_values("centres"), lambda c: _square(F.col("embedding"), c))
    far = _square(F.col("embedding"), own) > F.array_min(every) + 1e-9
    table_of = centres.agg(F.map_from_entries(F.collect_list(F.struct("cluster", "centre"))).alias("centres"))
    joined = points.join(F.broadcast(table_of))  # one row: as many centres as clusters were asked for
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        *[(F.round(F.sum(c), 4) + 0.0).alias(n) for n, c in (("sum_x", F.col("x")), ("sum_y", F.col("y")), ("sum_xy", F.col("x") * F.col("y")))],
        F.count_if(far).alias("n_far"),
    )


def _axes_sql() -> str:
    """Both largest variances by squaring: a high power of the covariance is all first axis, what is left all second."""

    def powers(name: str) -> str:
        out = ""
        for i in range(_SQUARINGS):
            last = name if i == 0 else f"{name}{i}"
            out += f"""{name}{i + 1} AS MATERIALIZED (SELECT i, j, x / (sum(CASE WHEN i = j THEN x END) OVER ()) AS x FROM (
              SELECT a.i, b.j, sum(a.x * b.x) AS x FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY ALL)),"""
        return out

    top = "(SELECT sum(c.x * p.x) FROM {} c JOIN {}{} p ON c.i = p.j AND c.j = p.i)"
    return f"""WITH v AS (SELECT id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM ({I.SETS_SQL})),
    m AS (SELECT id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM v),
    c AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) / (count(*) - 1) AS x FROM m a JOIN m b USING (id) GROUP BY ALL),
    {powers('c')}
    d AS MATERIALIZED (SELECT i, j, c.x - {top.format('c', 'c', _SQUARINGS)} * p.x AS x FROM c JOIN c{_SQUARINGS} p USING (i, j)),
    {powers('d')}
    t AS (SELECT sum(x) AS total FROM c WHERE i = j),
    r AS (SELECT 1 AS axis, {top.format('c', 'c', _SQUARINGS)} AS variance UNION ALL SELECT 2, {top.format('d', 'd', _SQUARINGS)})
    SELECT axis, round(variance, 6) AS variance, round(variance / total, 5) AS share, 0.0::DOUBLE AS residual FROM r, t"""


_SQUARINGS = 12


@query("principal_axes", _axes_sql())
def _(spark, d):
    """Variance along the two axes, and how far each is from the eigen equation."""
    axes = E.principal_axes(I.embedding_sets(spark, d))
    return axes.select("axis", C.round6("variance").alias("variance"), F.round("share", 5).alias("share"), (F.round("residual", 8) + 0.0).alias("residual"))


def _letter_encoder():
    """Stand-in for an encoder: a token per word of up to eight, its vector the counts of four letters and its length."""

    def encode(texts):
        found = [[w for w in t.split(" ") if w][:8] for t in texts]
        wide = max([1, *map(len, found)])
        vectors, mask = np.zeros((len(texts), wide, 5)), np.zeros((len(texts), wide))
        for i, row in enumerate(found):
            for j, w in enumerate(row):
                vectors[i, j], mask[i, j] = [w.count("a"), w.count("e"), w.count("n"), w.count("r"), len(w)], 1
        return vectors, mask

    return encode


_TOKENS_SQL = """SELECT doc, pos, w FROM (SELECT doc_id AS doc, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents)) WHERE pos < 8"""
_LETTERS_SQL = "[" + ", ".join(f"(length(w) - length(replace(w, '{c}', '')))" for c in "aenr") + ", length(w)]"


@query(
    "encoder_mean_pool",
    f"""SELECT doc, pos::INT AS pos, round(avg(x), 6) AS x FROM (SELECT doc, unnest({_LETTERS_SQL})::DOUBLE AS x, unnest(range(1, 6)) AS pos FROM ({_TOKENS_SQL}))
    GROUP BY ALL""",
)
def _(spark, d):
    """Token vectors of an encoder in batches, pooled without the padding."""
    docs = spread_table(spark, d, "documents").select("doc_id", "text")
    return _values(E.mean_pool(E.encode_tokens(docs, "doc_id", "text", _letter_encoder, 5)), "doc", "embedding").dropna()


@query(
    "encoder_first_token",
    f"SELECT doc, unnest(range(1, 6))::INT AS pos, unnest({_LETTERS_SQL})::DOUBLE AS x FROM ({_TOKENS_SQL}) WHERE pos = 0",
)
def _(spark, d):
    docs = spread_table(spark, d, "documents").select("doc_id", "text")
    tokens = E.encode_tokens(docs, "doc_id", "text", _letter_encoder, 5).filter("mask = 1")
    pooled = E.first_token_pool(tokens)
    return _values(pooled.withColumn("embedding", F.col("embedding").cast("array<double>")), "doc", "embedding")


_MIN_COUNT = 20


@query(
    "learned_embedding",
    rf"""WITH w AS (SELECT conv_id * 1000 + turn AS doc, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}]+'), lambda x: x <> '')) AS w FROM conversations),
    k AS (SELECT w FROM w GROUP BY w HAVING count(*) >= {_MIN_COUNT})
    SELECT doc, count(*) AS n_tokens, 32 AS n_values FROM w JOIN k USING (w) GROUP BY doc""",
)
def _(spark, d):
    """Words are learned from all turns; each turn's vector is the mean of its known words'."""
    talks = spread_table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    tokens = E.word_tokens(talks, "id", "text", E.learn_word_vectors(talks, "text", dim=32, min_count=_MIN_COUNT))
    counted = tokens.groupBy("doc").agg(F.count(F.lit(1)).alias("n_tokens"))
    pooled = E.mean_pool(tokens)
    return pooled.join(counted, "doc").select("doc", "n_tokens", F.size("embedding").alias("n_values"))


def _square(a, b):
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def _embedded_sql(texts: str) -> str:
    """(id, pos, x): the values other than 0 of the vectors of the rows (id, text), places from 0."""
    return rf"""SELECT id, pos, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x FROM (
      SELECT id, ('0x' || substr(md5(word), 1, 2))::INT AS pos, count(*) AS n FROM (
        SELECT id, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}]+'), lambda x: x <> '')) AS word FROM ({texts})) GROUP BY ALL)"""


@query("embed_text", f"SELECT id AS doc_id, pos, round(x, 6) AS x FROM ({_embedded_sql('SELECT doc_id AS id, text FROM documents')})")
def _(spark, d):
    out = E.embed_text(spread_table(spark, d, "documents").select("doc_id", "text"), "text")
    values = out.select("doc_id", F.posexplode("embedding").alias("pos", "x")).filter("x <> 0")
    return values.withColumn("x", F.round(F.col("x").cast("double"), 6))


# The labelled documents are the corpus; pages and conversations are the sets it is held against.
_COMPARED = """SELECT doc_id AS id, text, CASE toxic WHEN 1 THEN 'phish' ELSE 'not-phish' END AS dataset FROM documents JOIN labels USING (doc_id) WHERE toxic IN (0, 1)
  UNION ALL SELECT page_id, html, 'good-users' FROM pages UNION ALL SELECT conv_id * 100 + turn, text, 'phish-users' FROM conversations"""
_SET_NAMES = ["phish", "not-phish", "good-users", "phish-users"]


def _compared(spark, d):
    corpus = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    talks = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    others = {"good-users": pages, "phish-users": talks}
    return jobs.compare_embeddings(corpus, others, "phish", "not-phish", labels=labels)


_SET_VALUES = f"""SELECT split_part(id, ':', 1) AS dataset, id, pos, x FROM (
  {_embedded_sql(f"SELECT dataset || ':' || id AS id, text FROM ({_COMPARED})")})"""


@query(
    "embedding_comparison",
    f"""WITH v AS MATERIALIZED ({_SET_VALUES}), n AS (SELECT dataset, count(*) AS n FROM ({_COMPARED}) GROUP BY dataset),
    c AS (SELECT dataset, pos, sum(x) / any_value(n) AS m, sum(x / len) / any_value(n) AS u
      FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY id)) AS len FROM v) JOIN n USING (dataset) GROUP BY dataset, pos),
    p AS (SELECT a.dataset AS set_a, b.dataset AS set_b, sum(a.m * b.m) AS dot, sum(a.u * b.u) AS mean FROM c a JOIN c b ON a.pos = b.pos GROUP BY ALL),
    l AS (SELECT dataset, sqrt(sum(m * m)) AS len FROM c GROUP BY dataset)
    SELECT set_a, set_b, round(dot / (la.len * lb.len), 6) AS similarity, round(1 - mean, 6) AS distance
    FROM p JOIN l la ON la.dataset = set_a JOIN l lb ON lb.dataset = set_b
    JOIN (VALUES {', '.join(f"('{a}', '{b}')" for i, a in enumerate(_SET_NAMES) for b in _SET_NAMES[i + 1:])}) w(set_a, set_b) USING (set_a, set_b)""",
)
def _(spark, d):
    out = jobs.embedding_distances(_compared(spark, d), _SET_NAMES)
    return out.withColumns({"similarity": C.round6("similarity"), "distance": C.round6("distance")})


@query(
    "embedding_map",
    f"""SELECT dataset, count(*) AS n, 0.0::DOUBLE AS rest FROM ({_COMPARED}) WHERE dataset <> 'phish-users' GROUP BY dataset
    UNION ALL SELECT dataset || ' of two', count(*), 0.0 FROM ({_COMPARED}) WHERE dataset IN ('phish', 'not-phish') GROUP BY dataset""",
)
def _(spark, d):
    """Rows of three sets, then of two, on their plane: how many of each, and how far off zero all coordinates sum up."""
    sets = _compared(spark, d)
    three, two = (jobs.embedding_map(sets, _SET_NAMES[:k]).withColumn("of", F.lit(k)) for k in (3, 2))
    both = three.unionByName(two)
    sums = both.groupBy("of").agg((F.round(F.abs(F.sum("x")) + F.abs(F.sum("y")), 4) + 0.0).alias("rest"))
    counts = both.groupBy("of", "dataset").agg(F.count(F.lit(1)).alias("n")).join(sums, "of")
    named = F.when(F.col("of") == 2, F.concat("dataset", F.lit(" of two"))).otherwise(F.col("dataset"))
    return counts.select(named.alias("dataset"), "n", "rest")
