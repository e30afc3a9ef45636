import random

import pytest
from compare import connect, difference
from conftest import plan
from pyspark.sql import functions as F

from mailrisk.llm import mixing
from mailrisk.llm.queries import ORACLES, QUERIES


def test_query_equals_sql(spark, sf_dir):
    got = QUERIES["op5_mixing"](spark, sf_dir).toArrow()
    assert difference(got, connect(sf_dir).sql(ORACLES["op5_mixing"]).to_arrow_table()) is None


def _targets(sizes, weights=(5, 2, 1)):
    """Share, cut what is above the cap, share the excess among the others, again and again."""
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[n] for n in full)
        free = sum(weight[n] for n in names if n not in full)
        share = {n: 2.0 * sizes[n] if n in full else rest * weight[n] / free for n in names}
        above = {n for n in names if n not in full and share[n] > 2 * sizes[n]}
        if not above:
            return share
        full |= above


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, None: 5}, {"é": 7, "z": 900, "B": 0, "a": 30, None: 400}, {"one": 10}, {"x": 0, "y": 0},
])
def test_targets_are_shared_again_and_again(spark, sizes):
    df = spark.createDataFrame([(n, s) for n, s in sizes.items()], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = _targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert got == pytest.approx(want)


def _planned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, copies string, target string, _size int")
    return mixing.plan_copies(df, "doc_id", "source", "size")


def test_words_taken_come_near_the_targets(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["a", "b", "c", None] + ["hot"] * 4), int(rnd.lognormvariate(5, 1)), "", "", 1) for i in range(20_000)]
    out = _planned(spark, rows)
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in got)
    sizes = {}
    for r in rows:
        sizes[r[1]] = sizes.get(r[1], 0) + r[2]
    want = _targets(sizes)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(want[s]) and mine[0]["source_size"] == sizes[s]
        assert sum(r["taken"] for r in mine) == pytest.approx(want[s], rel=0.01)
    again = mixing.plan_copies(out.select("doc_id", "source", "size").repartition(5), "doc_id", "source", "size")
    assert sorted((r["doc_id"], r["copies"]) for r in again.collect()) == sorted((r["doc_id"], r["copies"]) for r in got)


def test_native_plan(spark, sf_dir):
    text = plan(QUERIES["op5_mixing"](spark, sf_dir))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_odd_rows(spark, odd_docs):
    got = mixing.mix(odd_docs, "doc_id", "source", "text")
    assert got.columns == odd_docs.columns
    counts = {tuple(r): r["count"] for r in got.groupBy("doc_id", "text", "source").count().collect()}
    assert counts and mixing.mix(odd_docs.limit(0), "doc_id", "source", "text").count() == 0
    one = spark.createDataFrame([(1, None, None), (2, None, ""), (None, "s", "a b")], "doc_id bigint, source string, text string")
    sized = one.withColumn("size", mixing.word_count(F.col("text")))
    rows = {r["doc_id"]: r for r in mixing.plan_copies(sized, "doc_id", "source", "size").collect()}
    assert rows[1]["taken"] == rows[2]["taken"] == 0 and rows[None]["target"] == 3.0 and rows[None]["taken"] in (2, 4)


def test_word_count(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t\n\x0b\x0c\r",), ("a  b\nc",), (" x y",)], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [0, 0, 0, 3, 1]


def test_rows_of_one_id_and_size_are_taken_alike_in_each_run(spark):
    rows = [(1, "s", f"word{i} text") for i in range(40)] + [(2, "t", "x " * 30)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    runs = [sorted(map(tuple, mixing.mix(df.repartition(n, "text" if n % 2 else "doc_id"), "doc_id", "source", "text").collect())) for n in (1, 4, 7)]
    assert runs[0] == runs[1] == runs[2] and 0 < len(runs[0])
