"""From raw documents to packed sequences: five stages, each on all the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.llm import mixing, packing, pii, quality, simhash
from mailrisk.llm.common import store, unused
from mailrisk.llm.queries import TOKENIZER
from mailrisk.llm.tokens import share_tokenizer
from mailrisk.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality.held_out("doc_id"))
    model = quality.fit(docs, labels, "doc_id", "text", "quality")
    name = unused(docs, "quality_score")
    scored = quality.score(docs, "text", model, out=name)
    return scored.filter(F.col(name) >= quality.THRESHOLD).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return simhash.drop_near_copies(docs, "doc_id", "text")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and their new length."""
    ship_package(spark)
    field = pii.train(pii.labelled_table())
    clean = pii.redact(docs, "text", field)
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs, "doc_id", "source", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    ship_package(spark)
    tokenizer = share_tokenizer(spark, public_tokenizers.path(TOKENIZER))
    return packing.pack_documents(docs, "doc_id", "text", tokenizer)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_copies", drop_copies),
    ("personal_data", redact),
    ("mixing", mix),
    ("packing", pack),
]

#: Scores, fingerprints and tokens have no SQL form; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
