"""Vectors of more lengths than have reference points link all the same, exactly."""

import numpy as np

from mailrisk.llm import pivots


def test_rare_lengths_are_compared_whole(spark, monkeypatch):
    rng, rows = np.random.default_rng(2), []
    for dim in range(2, 75):
        base = rng.normal(size=(3, dim))
        for k in range(6):
            v = base[k % 3] + 0.001 * rng.normal(size=dim)
            rows.append((len(rows), v.tolist(), dim % 2))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    want = {}
    for i, v, c in rows:
        unit = np.array(v) / np.linalg.norm(v)
        near = [j for j, w, d in rows if d == c and len(w) == len(v) and j != i and unit @ np.array(w) / np.linalg.norm(w) >= 0.93]
        want[i] = near
    for lengths, block in ((64, 512), (3, 512), (3, 2)):
        monkeypatch.setattr(pivots, "_LENGTHS", lengths)
        monkeypatch.setattr(pivots, "BLOCK", block)
        got = {r["id"]: r["n_links"] for r in pivots.near_copies(df, "vec_id", "embedding", "label").collect()}
        assert got == {i: len(n) for i, n in want.items()}
