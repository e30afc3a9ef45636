import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mailrisk.llm import common, simhash
from mailrisk.llm.queries import QUERIES


def _plain(text, k=4):
    """The contract word by word."""
    words, word = [], ""
    for c in (text or "") + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute(fps):
    """Component (smallest id) of each id by all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint():
    texts = [None, "", " \t", "One", "one  two\nthree", "A b C d", "a b c d e", "É é A\x0bb\x0cc \x1c d", "w " * 70_000]
    for t in texts:
        assert simhash.fingerprint(t if t is None else t.encode()) == _plain(t)


def test_counts_bound_the_distance(spark):
    rnd = random.Random(2)
    pairs = [(rnd.getrandbits(64) - 2**63, rnd.getrandbits(64) - 2**63) for _ in range(300)]
    pairs += [(a, a ^ (1 << rnd.randrange(62)) ^ (1 << rnd.randrange(62))) for a, _ in pairs]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    both = df.select("a", "b", simhash.segment_counts(F.col("a")).alias("x"), simhash.segment_counts(F.col("b")).alias("y"))
    for r in both.collect():
        counts = [[(v >> 2 * i & 3).bit_count() for i in range(32)] for v in (r["a"], r["b"])]
        manhattan = sum(abs(p - q) for p, q in zip(*counts))
        assert ((r["x"] ^ r["y"]) & (2**64 - 1)).bit_count() == manhattan <= ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count()


def test_every_near_pair_is_linked_once(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for n in (1, 2, 3, 4, 4, 5, 6):
            fps.add(b ^ sum(1 << k for k in rnd.sample(range(64), n)))
        fps.add(b ^ 3)  # a swap inside a segment may leave its count
    signed = sorted(int(np.uint64(f).astype(np.int64)) for f in fps)
    got = [tuple(r) for r in simhash.linked_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()]
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_query_is_brute_force(spark, sf_dir):
    rows = QUERIES["op1_simhash"](spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: _plain(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == _brute(fps)


def test_odd_rows(spark, odd_docs):
    got = simhash.near_copies(odd_docs, "doc_id", "text").collect()
    assert len(got) == odd_docs.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by_id[0] == by_id[1] == by_id[2] == {0}  # no words: fingerprint zero
    assert by_id[10] == by_id[11] == {10}
    assert by_id[None] == {None}
    empty = odd_docs.limit(0)
    assert simhash.near_copies(empty, "doc_id", "text").count() == 0


def test_one_of_each_group_stays(spark, odd_docs):
    kept = simhash.drop_near_copies(odd_docs, "doc_id", "text")
    assert kept.columns == odd_docs.columns
    got = kept.collect()
    # 0, 1 and 2 are one group; 10 and 11; the repeated row of id 5 is one
    assert sorted([r["doc_id"] for r in got], key=lambda x: (x is None, x)) == [0, 3, 4, 5, 5, 6, 7, 8, 9, 10, None]
    assert {r["text"] for r in got if r["doc_id"] == 5} == {"Ünïcödé ßtraße", "another text of id five"}
    same = spark.createDataFrame([(1, "equal rows here now", "x")] * 5 + [(2, "equal rows here now", "x")], "doc_id bigint, text string, a string")
    assert [tuple(r) for r in simhash.drop_near_copies(same, "doc_id", "text").collect()] == [(1, "equal rows here now", "x")]
    assert simhash.drop_near_copies(same.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("blocks", [5, 6, 7, 8, 12])
def test_any_number_of_blocks_gives_the_same_links(spark, blocks):
    rnd = random.Random(blocks)
    base = [rnd.getrandbits(64) for _ in range(25)]
    fps = sorted({int(np.uint64(b ^ sum(1 << k for k in rnd.sample(range(64), n))).astype(np.int64)) for b in base for n in range(7)})
    got = [tuple(r) for r in simhash.linked_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp bigint"), blocks=blocks).collect()]
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def _candidates(spark, n):
    """Pairs of random fingerprints that meet in a cell, with the blocks chosen for their number."""
    blocks = simhash.block_count(n)
    points = spark.range(n).select(F.xxhash64("id").alias("fp"))
    counts = points.select(simhash.segment_counts(F.col("fp")).alias("counts"))
    total = 0
    for chosen in combinations(range(blocks), blocks - 4):
        mask = simhash._signed(sum(simhash.block_masks(blocks)[i] for i in chosen))
        sizes = counts.groupBy(F.col("counts").bitwiseAND(F.lit(mask))).count()
        total += sizes.agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    return total


def test_candidates_of_a_point_do_not_grow_with_the_points(spark):
    for n in (60_000, 240_000):
        assert _candidates(spark, n) / n <= simhash.BY_CHANCE
    found = [simhash.block_count(n) for n in (1, 10**4, 10**6, 10**9)]
    assert found == sorted(found) and found[0] == 6 and found[-1] <= simhash.MOST_BLOCKS


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_points_are_not_broadcast(spark, tmp_path):
    """Spark takes the cells of all points for no more than the points, here 16 KB, and would send all to the driver."""
    spark.range(1000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/reps")
    links = simhash.linked_fingerprints(spark.read.parquet(f"{tmp_path}/reps"), blocks=12)
    assert "SortMergeJoin" in _plan(links) and "Broadcast" not in _plan(links)


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    plans, store = [], common.store

    def told(df, name, **options):
        if name != "edges":  # two numbers a row in files too: they are no larger in memory than Spark takes them for
            plans.append(_plan(df))
        return store(df, name, **options)

    for module in (common, simhash):
        monkeypatch.setattr(module, "store", told)
    texts = [f"copy {i % 40} of a text with {i % 40} words and {'more ' * (i % 40)}{'x' * (i >= 40)}" for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    kept = simhash.drop_near_copies(df, "id", "text")
    assert 0 < kept.count() < 80
    # two of the broadcasts, with the name of each, are those of heavy_join: at most 1000 rows
    counts = [p.count("BroadcastHashJoin") for p in (*plans, _plan(kept))]
    assert len(plans) > 4 and sorted(set(counts)) == [0, 2] and counts.count(2) == 1


def test_one_large_component_is_not_one_task(spark):
    """Nodes of a root that has many get its smallest id from a broadcast, so its rows stay where they are."""
    ends = spark.createDataFrame([(int(np.uint64((1 << 60) ^ (1 << k)).astype(np.int64)),) for k in range(40)] + [(5,), (7,), (1 << 50,)], "fp bigint")
    fps = ends.select((F.col("fp") % 97).alias("id"), "fp")
    found = simhash.group_fingerprints(fps, "id")
    assert _plan(found).count("BroadcastHashJoin") == 2
    got = {r["fp"]: r["component_id"] for r in found.collect()}
    signed = {r["fp"]: r["id"] for r in fps.collect()}
    near = _brute_least(signed)
    assert got == near


def _brute_least(ids):
    """The smallest id that each fingerprint reaches."""
    root = {f: f for f in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(ids, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
            root[find(a)] = find(b)
    return {f: min(ids[g] for g in ids if find(g) == find(f)) for f in ids}
