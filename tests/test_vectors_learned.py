"""Principal axes, encoder batches, learned word vectors and the sampling of files."""

import os
import random
from pathlib import Path
from uuid import uuid4

import duckdb
import numpy as np
import pytest
from conftest import plan
from pyspark.sql import functions as F

from mailrisk.operators import embeddings as E
from mailrisk.session import scratch_path
from mailrisk.sources import readers


def test_axes_are_those_of_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 1e6
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "embedding array<double>").repartition(7)
    n, mean, cov = E.covariance(df)
    assert n == 400 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T), rtol=1e-9)
    axes = E.principal_axes(df, 3).collect()
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose([a["variance"] for a in axes], values[:3])
    assert np.allclose([a["share"] for a in axes], values[:3] / values.sum()) and max(a["residual"] for a in axes) < 1e-8
    with pytest.raises(ValueError):
        E.covariance(df.limit(0))


def test_plane_of_the_clusters_lies_on_the_axes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) * [5, 3, 1, 0.5]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, embedding array<double>")
    points, _ = E.pca_kmeans(df)
    spread = points.agg(F.var_samp("x"), F.var_samp("y")).first()
    assert np.allclose(list(spread), [a["variance"] for a in E.principal_axes(df).collect()])


def test_encoder_is_loaded_once_in_each_worker_and_padding_does_not_count(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        Path(folder, f"{os.getpid()}-{uuid4().hex}").touch()

        def encode(texts):
            wide = max(1, *map(len, texts))
            mask = np.array([[1] * len(t) + [0] * (wide - len(t)) for t in texts])
            return np.array([[[ord(c), 1] for c in t.ljust(wide)] for t in texts]), mask

        return encode

    texts = ["ab", "", None, "abcde", "z"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(12)
    tokens = E.encode_tokens(df, "id", "t", make, 2, batch_size=7)
    pooled = {r["doc"]: r["embedding"] for r in E.mean_pool(tokens).collect()}
    for i, t in enumerate(texts):
        want = [np.mean([ord(c) for c in t]), 1.0] if t else None
        assert pooled[i] is None if want is None else np.allclose(pooled[i], want)
    pids = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert len(pids) == len(set(pids))
    with pytest.raises(Exception, match="must give vectors of 3 values"):
        E.encode_tokens(df, "id", "t", make, 3).collect()


def test_words_that_stand_in_the_same_places_are_near(spark):
    rnd = random.Random(8)
    places = [("red", "green", "blue"), ("run", "walk", "swim"), ("one", "two", "three")]
    rows = []
    for i in range(3000):
        kind = i % 3
        a, b = rnd.sample(places[kind], 2)
        rows.append((i, f"{'xyz'[kind]}a {a} {'xyz'[kind]}b {b} {'xyz'[kind]}c"))
    df = spark.createDataFrame(rows, "id int, t string").coalesce(1)
    vectors = {r["word"]: np.array(r["vec"]) for r in E.learn_word_vectors(df, "t", dim=16, min_count=2).collect()}
    groups = [w for p in places for w in p]

    def near(w):
        sims = {v: vectors[w] @ vectors[v] / np.linalg.norm(vectors[w]) / np.linalg.norm(vectors[v]) for v in groups if v != w}
        return sorted(sims, key=sims.get)[-2:]

    for p in places:
        for w in p:
            assert set(near(w)) == set(p) - {w}


def test_pooled_words_equal_the_token_table_pooled_in_sql(spark):
    df = spark.createDataFrame([(1, "A b b c"), (2, "c"), (3, "unknown"), (4, None)], "id int, t string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("c", [0.5, 0.0])], "word string, vec array<float>")
    path = scratch_path(spark, "tokens")
    E.word_tokens(df, "id", "t", vectors).write.parquet(path)
    sql = f"SELECT doc, list(x ORDER BY i) FROM (SELECT doc, i, avg(x) AS x FROM (SELECT doc, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM '{path}/*.parquet') GROUP BY ALL) GROUP BY doc ORDER BY doc"
    got = E.mean_pool(spark.read.parquet(path)).orderBy("doc").collect()
    assert [(r["doc"], r["embedding"]) for r in got] == duckdb.sql(sql).fetchall() == [(1, [1.875, 2.5]), (2, [0.5, 0.0])]


def test_sampling_of_files_is_bounded_on_the_driver(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.range(100).withColumn("part", F.col("id") % 10).repartition(10, "part").write.partitionBy("part").parquet(path)
    first = readers.sample_files(spark, [path], 3, seed=1)
    assert first.select("part").distinct().count() == 3 and first.count() == 30
    assert readers.sample_files(spark, [path], 3, seed=1).collect() == first.collect()
    assert len({frozenset(r["part"] for r in readers.sample_files(spark, [path], 3, seed=s).collect()) for s in range(6)}) > 1
    names = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("p")).groupBy("p").count().orderBy(F.xxhash64("p")).limit(3)
    assert "TakeOrderedAndProject" in plan(names)
