"""The pipeline's stages against brute force, each on its own input."""

import subprocess
import sys

import numpy as np
from conftest import ROOT

import corpus_pipeline
from mailrisk.llm import pii, quality, simhash
from mailrisk.session import scratch_path


def _stored(df, spark):
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_one_after_the_other(spark, sf_dir, plain_tokenizer):
    from llm.test_tokens import _crc

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "personal_data", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}

    kept = _stored(stages["quality"](spark, docs, sf_dir), spark)
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert all(given[i] == r for i, r in rows.items())
    good = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in rows for i in good]) >= 0.98
    # a dozen bad examples to learn from here; the accuracy test has more
    assert np.mean([i in rows for i, q in labels.items() if q == 0]) <= 0.3

    single = _stored(stages["near_copies"](spark, kept, sf_dir), spark)
    assert single.columns == docs.columns
    fps = {i: simhash.fingerprint(r["text"].encode()) for i, r in rows.items()}
    root = {i: i for i in fps}
    while True:
        new = {i: min(root[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4) for i in fps}
        if new == root:
            break
        root = new
    alone = {r["doc_id"]: r for r in single.collect()}
    assert single.count() == len(alone) and set(alone) == {i for i in root if root[i] == i}

    clean = _stored(stages["personal_data"](spark, single, sf_dir), spark)
    assert clean.columns == docs.columns and clean.count() == len(alone)
    texts = {r["doc_id"]: r for r in clean.collect()}
    field = pii.train(pii.labelled_table())
    for i, r in texts.items():
        spans = pii.all_spans([alone[i]["text"]], field)[0][1]
        assert r["text"] == pii.redact_text(alone[i]["text"], spans) and r["n_chars"] == len(r["text"])
        assert not any(pii.base_spans(r["text"]).values())

    mixed = _stored(stages["mixing"](spark, clean, sf_dir), spark)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(counts) <= set(texts) and max(counts.values()) <= 2
    words = lambda i: len(texts[i]["text"].split())
    total = sum(map(words, texts))
    assert abs(sum(n * words(i) for i, n in counts.items()) - 1.5 * total) <= 0.1 * total

    packed = stages["packing"](spark, mixed, sf_dir).collect()
    assert sum(r["piece"] == 0 for r in packed) == sum(counts.values())
    for r in packed[:200]:
        ids = plain_tokenizer.encode(texts[r["doc_id"]]["text"], add_special_tokens=False).ids + [2]
        assert r["ids_crc32"] == _crc(ids[r["start"] : r["start"] + r["length"]])


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


def test_odd_documents_pass_every_stage(spark, sf_dir, odd_docs):
    docs = odd_docs
    for stage in (f for _, f in corpus_pipeline.STAGES):
        docs = _stored(stage(spark, docs, sf_dir), spark)
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for stage in (f for _, f in corpus_pipeline.STAGES):
        empty = _stored(stage(spark, empty, sf_dir), spark)
    assert empty.count() == 0


def test_the_rest_does_not_need_this_folder():
    program = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("mailrisk.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
assert "pipeline" not in e.queries() and not any(n.startswith("op") for n in e.queries())
assert len(e.queries()) > 100 and not any(m.startswith("mailrisk.llm") for m in sys.modules)
"""
    run = subprocess.run([sys.executable, "-c", program], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-1500:]


def test_quality_model_learns_from_no_held_out_label(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", (1 - labels["quality"]).cast("int")).filter(quality.held_out("doc_id"))
    mine = labels.filter(~quality.held_out("doc_id"))
    a = quality.fit(docs, mine, "doc_id", "text", "quality")
    b = quality.fit(docs, mine.unionByName(flipped).filter(~quality.held_out("doc_id")), "doc_id", "text", "quality")
    x = np.random.default_rng(0).random((20, len(quality.FEATURES)))
    assert (a.score(x) == b.score(x)).all()
