"""Operators with a learned model: held-out accuracy, determinism, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailrisk.llm import langid, quality
from mailrisk.llm.queries import QUERIES

BIG = "/root/testdata/sf0.1"


def _crc(i):
    return zlib.crc32(str(i).encode())


def test_language_of_held_out_documents(spark):
    got = QUERIES["op2_language"](spark, BIG).join(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 10_000
    assert all(r["held_out"] == (_crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.97
    for lang in {r["lang"] for r in held}:
        assert np.mean([r["lang_pred"] == lang for r in held if r["lang"] == lang]) >= 0.95


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "quality")
    got = QUERIES["op7_quality"](spark, BIG)
    assert got.count() == 10_000
    rows = got.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (_crc(r["doc_id"]) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    good, bad = [r for r in held if r["quality"] == 1], [r for r in held if r["quality"] == 0]
    assert np.mean([r["predicted"] for r in good]) >= 0.99
    assert np.mean([r["predicted"] for r in bad]) <= 0.1


def test_models_do_not_depend_on_partitions(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    a = quality.fit(docs, labels, "doc_id", "text", "quality")
    b = quality.fit(docs.repartition(5), labels.repartition(3), "doc_id", "text", "quality")
    x = np.random.default_rng(0).random((50, len(quality.FEATURES))) * 3
    assert (a.score(x) == b.score(x)).all()
    m = langid.fit(docs, "doc_id", "text", "lang")
    n = langid.fit(docs.repartition(5), "doc_id", "text", "lang")
    assert m.classes == n.classes and (m.embedding == n.embedding).all() and (m.out == n.out).all()


def test_windows_cover_every_filter_position():
    rng = np.random.default_rng(2)
    for n in (1, 3, 255, 256, 257, 253 + 256, 5000):
        data = rng.integers(1, 256, n, dtype=np.uint8)
        w = langid.windows(data.tobytes())
        flat = np.concatenate([r[: langid._STEP] for r in w])
        assert (flat[:n] == data[: len(flat)]).all() and w.shape[1] == langid.WINDOW
        assert len(w) * langid._STEP + 3 >= n and (len(w) == 1 or (len(w) - 1) * langid._STEP + langid.WINDOW < n + langid._STEP)


def test_scorer_is_the_network():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (300, langid.WINDOW), dtype=np.uint8)
    net = langid.train(x[:64], rng.integers(0, 3, 64), ["a", "b", "c"], epochs=1)
    e = net.embedding[x]
    pooled = []
    for f in net.filters:
        conv = sum(e[:, j : j + langid._STEP] @ f[j] for j in range(f.shape[0]))
        pooled.append(conv.max(axis=1))
    want = langid._softmax(np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias)
    assert np.allclose(net.scorer()(x), want, atol=1e-5)


def test_gradients_are_right():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 256, (8, langid.WINDOW), dtype=np.uint8), rng.integers(0, 3, 8)
    net = langid.train(x, y, ["a", "b", "c"], epochs=1)
    for name in ("embedding", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters = [f.astype(np.float64) for f in net.filters]
    weights = [net.embedding, *net.filters, net.bias, net.out, net.out_bias]

    def loss():
        e = net.embedding[x]
        pooled = [sum(e[:, j : j + langid._STEP] @ f[j] for j in range(f.shape[0])).max(axis=1) for f in net.filters]
        p = langid._softmax(np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias)
        return -np.log(p[np.arange(8), y]).mean()

    for p, g in zip(weights, langid._gradients(net, x, y)):
        for i in map(int, rng.integers(0, p.size, 6)):
            old, step = p.flat[i], 1e-5
            p.flat[i] = old + step
            up = loss()
            p.flat[i] = old - step
            down = loss()
            p.flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(g.flat[i], abs=1e-4)


def test_language_of_odd_rows(spark, sf_dir, odd_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.fit(docs, "doc_id", "text", "lang")
    got = langid.predict(odd_docs, "doc_id", "text", net)
    assert got.count() == odd_docs.count()
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert {i for i, r in by_id.items() if r["lang_pred"] == "und"} == {0, 1, 2, 4}
    assert all(0 <= r["score"] <= 1 for r in by_id.values())
    assert langid.predict(odd_docs.limit(0), "doc_id", "text", net).count() == 0
    assert langid.fit(odd_docs.filter("lang IS NULL"), "doc_id", "text", "lang") is None
    assert {r["lang_pred"] for r in langid.predict(odd_docs, "doc_id", "text", None).collect()} == {"und"}


def test_quality_of_odd_rows(spark, odd_docs):
    labels = odd_docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("mark"))
    model = quality.fit(odd_docs, labels, "doc_id", "text", "mark")
    got = quality.score(odd_docs, "text", model, out="q")
    assert got.columns == [*odd_docs.columns, "q"]
    assert all(0 <= r["q"] <= 1 for r in got.collect()) and got.count() == odd_docs.count()
    nothing = quality.fit(odd_docs, labels.limit(0), "doc_id", "text", "mark")
    assert {r["q"] for r in quality.score(odd_docs, "text", nothing, out="q").collect()} == {0.5}
    one = quality.fit(odd_docs, labels.filter("mark = 1"), "doc_id", "text", "mark")
    assert all(r["q"] > 0.5 for r in quality.score(odd_docs, "text", one, out="q").collect())
    assert quality.score(odd_docs.limit(0), "text", model, out="q").count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.fit_tables(x, y)
    assert (7, 2) in model.pairs
    fresh = rng.random((1000, len(quality.FEATURES)))
    want = (fresh[:, 2] > 0.5) ^ (fresh[:, 7] > 0.5)
    assert ((model.score(fresh) > 0.5) == want).mean() > 0.9
    # a score is a sum of table entries
    one = fresh[:1]
    total = model.base + sum(t[np.searchsorted(e, one[0, j], side="right")] for j, (e, t) in enumerate(zip(model.edges, model.tables)))
    for (i, j), t in zip(model.pairs, model.pair_tables):
        total += t[np.searchsorted(model.pair_edges[i], one[0, i], side="right"), np.searchsorted(model.pair_edges[j], one[0, j], side="right")]
    assert model.score(one)[0] == pytest.approx(1 / (1 + np.exp(-total)))
