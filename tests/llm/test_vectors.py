import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from mailrisk.llm import hnsw, pivots
from mailrisk.llm.queries import ORACLES, QUERIES

_SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, id string, rank string, n_rows string, vector string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c", "c", "c") for r in rows], _SCHEMA)


@pytest.mark.parametrize("name", ["op9_nearest", "op10_embedding_copies"])
def test_query_equals_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    assert difference(got, connect(sf_dir).sql(ORACLES[name]).to_arrow_table()) is None


def _exact(ids, vectors, query_ids, top=10):
    out = {}
    for q in query_ids:
        v = vectors[np.flatnonzero(ids == q)[0]]
        d = np.sqrt(((vectors - v) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:top]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def test_recall_against_brute_force_over_shards(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    vectors = centres[rng.integers(0, 30, 6000)] + 0.3 * rng.normal(size=(6000, 24))
    vectors[:1500] = vectors[0]  # a very common vector
    vectors[1500:2200] = vectors[1500] + 1e-3 * rng.normal(size=(700, 24))  # a tight group
    vectors = vectors.astype(np.float32).astype(np.float64)
    ids = np.arange(6000)
    df = _frame(spark, [(i, v.tolist(), 0) for i, v in zip(ids.tolist(), vectors)])
    got = {}
    found = hnsw.nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, shard_rows=1000)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = _exact(ids, vectors, range(0, 6000, 100))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.97
    assert got[0] == want[0]  # ties between equal vectors: the smallest ids
    for q in got:
        assert got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))
        for i, s in got[q]:
            assert s == pytest.approx(np.sqrt(((vectors[i] - vectors[q]) ** 2).sum()), abs=1e-12)


ODD = [
    (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1),
    (7, [float("inf"), 1.0], 1), (8, [0.999, 0.01], None), (9, [0.999, 0.02], 1), (10, [0.0, 1.0], 2), (100, [1.0, 0.0], 2), (None, [1.0, 0.0], 1),
    (200, [1.0, 2.0, 3.0], 1), (201, [2.0, 4.0, 6.0], 1), (300, None, 1), (11, [-0.0, 1.0], 2),
]


def test_nearest_of_odd_rows(spark):
    df = _frame(spark, ODD)
    got = {}
    for r in hnsw.nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert got[0] == [(1, 1), (2, 100), (3, 8), (4, 9), (5, 10), (6, 11)]
    assert got[100] == [(1, 0), (2, 1), (3, 8), (4, 9), (5, 10), (6, 11)]
    assert got[200] == [(1, 201)] and set(got) == {0, 100, 200}
    assert hnsw.nearest(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 0
    assert hnsw.nearest(df.filter("vec_id = 0"), "vec_id", "embedding", F.lit(True)).count() == 0


def test_graph_is_flat_and_layered():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 8))
    graph = hnsw.build(np.arange(2000), x)
    sizes = [int((layer >= 0).any(axis=1).sum()) for layer in graph.layers]
    assert sizes[0] == 2000 and sizes == sorted(sizes, reverse=True) and len(sizes) >= 2
    assert graph.layers[0].shape == (2000, 2 * hnsw.NEIGHBOURS) and graph.layers[0].dtype == np.int32
    for layer in graph.layers:
        for row in layer[(layer >= 0).any(axis=1)][:200]:
            linked = row[row >= 0]
            assert len(set(linked.tolist())) == len(linked)


def _links(ids, vectors, labels, least=0.93):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    root = ids.copy()
    while True:
        new = np.array([min([root[i], *root[near[i]]]) for i in range(len(ids))])
        if (new == root).all():
            return near.sum(axis=1), root
        root = new


def test_copies_are_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 32))
    labels = rng.integers(0, 3, 1500)
    for i in range(300, 500):  # near copies of the first ones, some of another label
        vectors[i] = vectors[i - 300] + 0.15 * rng.normal(size=32)
        labels[i] = labels[i - 300] if i % 4 else 1
    vectors[600:800] = vectors[600] + 0.05 * rng.normal(size=(200, 32))  # one large group of near copies
    vectors[900:1000] = vectors[900]  # and one of exact copies
    labels[600:1000] = 1
    vectors = vectors.astype(np.float32).astype(np.float64)
    ids = np.arange(1500) * 3 + 1
    want_n, want_root = _links(ids, vectors, labels)
    df = _frame(spark, [(int(i), v.tolist(), int(c)) for i, v, c in zip(ids, vectors, labels)])
    for block in (512, 40):
        monkeypatch.setattr(pivots, "BLOCK", block)
        rows = {r["id"]: r for r in pivots.near_copies(df, "vec_id", "embedding", "label").collect()}
        got_n = np.array([rows[int(i)]["n_links"] for i in ids])
        assert (got_n <= want_n).all() and got_n.sum() >= 0.98 * want_n.sum()
        assert np.mean([rows[int(i)]["component_id"] == r for i, r in zip(ids, want_root)]) >= 0.98
        assert all(r["kept"] == (r["id"] == r["component_id"]) for r in rows.values())
        assert (got_n[900:1000] >= 99).all()


def test_copies_of_odd_rows(spark):
    rows = pivots.near_copies(_frame(spark, ODD), "vec_id", "embedding", "label").collect()
    assert len(rows) == len(ODD)
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in rows}
    assert got[0] == got[1] == got[9] == (3, 0) and got[None] == (3, 0)
    assert got[10] == got[11] == (1, 10) and got[100] == (0, 100)
    assert got[200] == got[201] == (1, 200)
    for i in (2, 3, 4, 5, 6, 7, 8, 300):
        assert got[i] == (0, i)
    assert {r["id"] for r in rows if r["kept"]} == {0, 2, 3, 4, 5, 6, 7, 8, 10, 100, 200, 300}
    assert pivots.near_copies(_frame(spark, []), "vec_id", "embedding", "label").count() == 0
    assert pivots.near_copies(_frame(spark, ODD[2:5]), "vec_id", "embedding", "label").count() == 3
