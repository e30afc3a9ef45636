"""Rows that repeat the query's id leave their places to other rows with the same vector."""

import numpy as np

from mailrisk.llm import hnsw


def test_copies_of_the_query_hide_no_equal_vector():
    ids = np.array([100] * 15 + [200, 201] + list(range(300, 330)))
    rng = np.random.default_rng(4)
    vectors = np.concatenate([np.ones((17, 4)), 5 + rng.random((30, 4))])
    found = hnsw.search(hnsw.build(ids, vectors), np.array([100]), np.ones((1, 4)))
    assert [(i, s) for _, i, s in found[:2]] == [(200, 0.0), (201, 0.0)]
    assert len(found) == hnsw.TOP and all(i != 100 for _, i, _ in found)
