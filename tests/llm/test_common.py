import random

from pyspark.sql import functions as F

from mailrisk.llm.common import bounded_sample, components, heavy_join


def _brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in links)}


def test_components_of_chains_stars_and_rings(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(0, 200)] + [(500, 500 + i) for i in range(1, 60)] + [(700, 701), (701, 702), (702, 700)]
    links += [(rnd.randrange(1000, 1300), rnd.randrange(1000, 1300)) for _ in range(140)] + [(7, 7), (None, 3), (-5, 900)]
    rnd.shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(df, "a", "b").collect()}
    assert got == _brute(links)
    assert components(df.limit(0), "a", "b").count() == 0


def test_heavy_join_is_a_left_join(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 100 == 1, None).otherwise(F.col("id")).alias("k"))
    lookup = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).filter("k IS NOT NULL AND k % 7 <> 0")
    got = heavy_join(df, lookup, "k", "n", 6000)
    want = df.join(lookup.drop("n"), "k", "left")
    assert sorted(map(tuple, got.select("id", "k", "top").collect())) == sorted(map(tuple, want.select("id", "k", "top").collect()))


def test_heavy_join_broadcasts_only_what_it_bounds(spark):
    df = spark.range(6000).select("id", F.pmod("id", F.lit(3000)).alias("k"))
    lookup = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    plan = heavy_join(df, lookup, "k", "n", 6000)._jdf.queryExecution().executedPlan().toString()
    # the rows of heavy keys, and their names; every other key goes by a shuffle
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1


def test_bounded_sample_is_the_same_for_any_partitions(spark):
    df = spark.range(10_000)
    a = [r[0] for r in bounded_sample(df.repartition(7), "id", 100).collect()]
    assert len(a) == 100 and a == [r[0] for r in bounded_sample(df.repartition(2), "id", 100).collect()]
    assert bounded_sample(df.limit(30), "id", 100).count() == 30
