"""Predictions of the learned operators against the model written out text by text."""

import numpy as np
from pyspark.sql import functions as F

from mailrisk.llm import langid, quality


def plain_language(net, text):
    """Every filter at every place of every window, window by window."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = text.encode()
    starts = range(0, max(1, len(data) - langid.WINDOW + langid._STEP), langid._STEP)
    total, weights = np.zeros(len(net.classes)), 0
    starts = list(starts)[: max(1, -(-(len(data) - langid.WINDOW) // langid._STEP) + 1)]
    for k, start in enumerate(starts):
        window = np.zeros(langid.WINDOW, dtype=np.int64)
        piece = data[start : start + langid.WINDOW]
        window[: len(piece)] = list(piece)
        pooled = []
        for f in net.filters:
            e = net.embedding[window].astype(float)
            pooled.append(np.max([sum(e[i + j] @ f[j] for j in range(len(f))) for i in range(langid._STEP)], axis=0))
        z = np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.out + net.out_bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        weight = langid._STEP if k < len(starts) - 1 else len(data) - k * langid._STEP
        total, weights = total + p * weight, weights + weight
    return net.classes[int(total.argmax())], float(total.max() / weights)


def test_language_is_the_network_applied_to_each_text(spark, sf_dir, odd_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.fit(docs, "doc_id", "text", "lang")
    short = docs.filter(F.length("text") < 1200).select("doc_id", "text").limit(25)
    odd = odd_docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 1000).select("doc_id", "text")
    rows = short.unionByName(odd).withColumn("n", F.monotonically_increasing_id())
    got = {r["n"]: (r["lang_pred"], r["score"]) for r in langid.predict(rows, "n", "text", net).collect()}
    for r in rows.collect():
        name, score = plain_language(net, r["text"])
        assert got[r["n"]][0] == name and abs(got[r["n"]][1] - score) < 1e-3


def plain_features(text):
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, size = len(words), len(data)

    def count(test):
        return sum(1 for b in data if test(chr(b)) and b < 128)

    letters, capitals = count(str.isalpha), count(str.isupper)
    marks = sum(1 for b in data if 33 <= b < 127 and not chr(b).isalnum())
    plain_marks = sum(1 for b in data if chr(b) in ".,;:'\"-()?")
    lines = [line for line in data.split(b"\n") if line.strip()]
    ends = tuple(chr(b).encode() for b in b"!#$%&*+/<=>@\\^_`{|}~")
    return [
        np.log(1 + size), sum(1 for b in data if b not in b"\t\n\x0b\x0c\r ") / n, sum(len(w) > 15 for w in words) / n,
        capitals / max(1, letters), sum(1 for b in data if b in b"0123456789") / size, marks / size, (marks - plain_marks) / size,
        data.count(b"|") / n, len(lines) / n, sum(b >= 128 for b in data) / size, len(set(words)) / n,
        max(words.count(w) for w in set(words)) / n, sum(w.endswith(ends) for w in words) / n, sum(w.isupper() for w in words) / n,
        1 - len(set(lines)) / len(lines), sum(len(w) < 4 for w in words) / n,
    ]


def plain_score(model, x):
    total = model.base
    for edges, table, v in zip(model.edges, model.tables, x):
        total += table[sum(v >= e for e in edges)]
    for (i, j), table in zip(model.pairs, model.pair_tables):
        total += table[sum(x[i] >= e for e in model.pair_edges[i])][sum(x[j] >= e for e in model.pair_edges[j])]
    return 1 / (1 + np.exp(-total))


def test_quality_is_the_tables_applied_to_each_text(spark, sf_dir, odd_docs):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, "doc_id", "text", "quality")
    rows = docs.filter(F.length("text") < 20_000).select("doc_id", "text").limit(80).unionByName(odd_docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 1000).select("doc_id", "text"))
    for r in quality.score(rows, "text", model).collect():
        x = plain_features(r["text"])
        assert np.allclose(quality.features(r["text"]), x)
        assert abs(r["score"] - plain_score(model, quality.features(r["text"]))) < 1e-9
