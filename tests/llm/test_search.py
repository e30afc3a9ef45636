"""Reversed search against its rule, document by document."""

import math
import re

import pyarrow as pa
import pytest

from mailrisk.llm import search as S
from mailrisk.llm.tokenize import numbered, text_chunks, word_runs

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def by_hand(docs, items, top=20):
    found = [(i, plain_terms(t)) for i, t in docs]
    found = [(i, t) for i, t in found if t]
    n_docs, n_terms = len(found), sum(len(t) for _, t in found)
    out = []
    for item, text in set(items):
        wanted, scored = plain_terms(text), []
        for i, t in found:
            m, score = 75 + (25 * len(t) * n_docs) // n_terms, 0
            for w in wanted:
                if tf := t.count(w):
                    df = sum(w in u for _, u in found)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 12 * m))
            if score:
                scored.append((score, i))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(item, r, i, s) for r, (s, i) in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=repr)


def test_odd_rows_ties_and_repeats(spark, odd_docs):
    items = [(1, "one same text"), (1, "one same text"), (2, None), (3, ""), (None, "TEXT again text"), (5, "nowhere"), (6, "日本語 x ünïcödé")]
    asked = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, score string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = by_hand(docs, [i for i in items if i[1] is not None])
    assert rows(S.search(odd_docs, "doc_id", "text", asked, "item_id", "text")) == want
    assert {w[0] for w in want} >= {1, None, 6}


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_table_against_the_rule(spark, sf_dir, monkeypatch, size):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    some = items.limit(6)
    want = by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in some.collect()], 5)
    assert rows(S.search(docs.repartition(7), "doc_id", "text", some, "item_id", "text", top=5, slice_bytes=size)) == want


def test_empty_tables(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert S.search(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert S.search(docs, "doc_id", "text", items.limit(0), "item_id", "text").columns == ["item_id", "rank", "doc_id", "score"]


def test_sums_are_exact_beyond_doubles():
    import numpy as np

    index = S._Index([[b"a"] * 3 + [b"b"], [b"b"]], [b"a", b"b"])
    index.weights[:] = [2**52 + 1, 2**40 + 7]
    one = np.array([0, 0]), np.array([0, 1]), np.array([1, 1]), np.array([10**7])
    factor = 10**9 // (1000 + 12 * 10**7)
    assert index.scores(*one).tolist() == [[factor * (3 * (2**52 + 1) + 2**40 + 7), factor * (2**40 + 7)]]


def test_runs_cut_long_texts_between_words():
    texts = ["ab cd " * 50, "", "x" * 300, "É1é"]
    parts = [w for run in word_runs([t.encode() for t in texts], S._TABLE, 64) for w in run]
    assert parts == [w for run in word_runs([t.encode() for t in texts], S._TABLE, 1 << 20) for w in run]
    assert max(len(run) for run in word_runs([texts[0].encode()], S._TABLE, 64)) < 30
    assert numbered([], S._TABLE, len).tolist() == []
    assert [(i, len(h)) for i, h in text_chunks(pa.array(["aa", None, "bbb", "c"]), 3)] == [(0, 2), (2, 1), (3, 1)]
