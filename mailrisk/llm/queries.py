"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.llm import collocation, hnsw, langid, mixing, packing, pii, pivots, quality, search, simhash, token_file, warc, wrapper
from mailrisk.llm.common import store
from mailrisk.llm.tokens import share_tokenizer
from mailrisk.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id")
    net = langid.fit(docs.filter(~out), "doc_id", "text", "lang")
    found = langid.predict(docs, "doc_id", "text", net)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokenizer = share_tokenizer(spark, public_tokenizers.path(TOKENIZER))
    token_file.write_token_files(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer, path)
    return token_file.read_token_digests(spark, path)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html", path)
    return warc.page_digests(spark, path)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = store(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "mix-sizes")
    planned = mixing.plan_copies(sized, "doc_id", "source", "size")
    return planned.select("doc_id", "size", "source_size", "target", "taken")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = pii.train(pii.labelled_table())
    return pii.find(table(spark, sf_dir, "documents"), "doc_id", "text", field)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.held_out("doc_id")
    model = quality.fit(docs, labels.filter(~out), "doc_id", "text", "quality")
    scored = quality.score(docs.select("doc_id", "text"), "text", model)
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scored.select("doc_id", out.alias("held_out"), "score", predicted.alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = share_tokenizer(spark, public_tokenizers.path(TOKENIZER))
    return packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op10_embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pivots.near_copies(vectors, "vec_id", "embedding", "label").withColumnRenamed("id", "vec_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"), "text", "lang")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return search.search(docs, "doc_id", "text", items, "item_id", "text")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"), "page_id", "url", "html")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_language, op3_token_file, op4_warc, op5_mixing, op6_personal_data, op7_quality, op8_packing,
        op9_nearest, op10_embedding_copies, op11_collocations, op12_search, op13_main_text,
    )
}

_OP9 = """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""

_OP4 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, sha1(html) AS hex FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""

_OP10 = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {pivots.MIN_COSINE}),
reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT l.id AS vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, l.component_id, l.id = l.component_id AS kept
FROM least l LEFT JOIN n ON n.a = l.id
"""

ORACLES: dict[str, str] = {
    "op4_warc": _OP4,
    "op5_mixing": mixing.ORACLE_SQL,
    "op9_nearest": _OP9,
    "op10_embedding_copies": _OP10,
    "op11_collocations": collocation.ORACLE_SQL,
    "op12_search": search.ORACLE_SQL,
    "op13_main_text": wrapper.ORACLE_SQL,
}
