"""Operators against brute force on small frames."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from conftest import plan
from pyspark.sql import functions as F

from mailrisk.functions import vectors as V
from mailrisk.operators import cohort, geo, joins, ranking, report, rows
from mailrisk.operators import embeddings as E
from mailrisk.operators.language import fit_language, detect_language, translate
from mailrisk.operators.bayes import SLOTS, features, fit_bayes, load_bayes, term_counts, trigrams, words
from mailrisk.session import scratch_path
from mailrisk.sources import readers


def test_suspension_window(spark):
    mails = spark.createDataFrame(
        [(1, d, dt.datetime(2024, 1, d)) for d in (6, 7, 8, 12)], "user_id int, msg_id int, email_date timestamp_ntz"
    )
    susp = spark.createDataFrame([(1, dt.datetime(2024, 1, 10, 8))], "user_id int, created_at timestamp_ntz")
    for rows_allowed in (1000, 0):
        ids = lambda **k: sorted(r["msg_id"] for r in cohort.suspension_window(mails, susp, rows=rows_allowed, **k).collect())
        assert ids() == [8, 12]
        assert ids(upper=True) == [8]


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_salted_lookup_keeps_every_row(spark, how):
    # a third of the rows has one key, some keys are null or unknown
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 11).alias("k")
    )
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(8)], "k bigint, v string")
    a = joins.lookup_join(df, lookup, "k", spread="id", how=how)
    b = joins.lookup_join(df, lookup, "k", spread="id", how=how, rows=0, salts=5)
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_copies_of_a_large_lookup_are_not_broadcast(spark, tmp_path):
    """Files as small as these Spark would send to every task, the copies of each row with them."""
    spark.range(4000).select("id", F.concat("id", F.lit(".html")).alias("filename"), F.lit("f").alias("file_id")).write.parquet(f"{tmp_path}/links")
    links = spark.read.parquet(f"{tmp_path}/links").drop("id")
    mails = spark.range(6000).select(F.col("id").cast("string").alias("msg_id"))
    found = cohort.attach_file_links(mails, links, rows=0)
    assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
    assert found.filter("HTML_File_Link = 'Not Found'").count() == 2000
    missing = cohort.count_unmapped(mails, links)
    assert "SortMergeJoin" in plan(missing) and "Broadcast" not in plan(missing)
    assert missing.first()[0] == 2000


def test_counted_join_copies_only_busy_keys(spark):
    data = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 11).cast("string").alias("k")
    )
    lookup = spark.createDataFrame([(str(k), f"v{k}") for k in range(9)], "k string, v string")
    counts = data.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = joins.counted_join(data, lookup, counts, "k", "id", "n", hot=500)
    assert sorted(map(tuple, out.select("id", "k", "v").collect())) == sorted(map(tuple, data.join(lookup, "k", "left").select("id", "k", "v").collect()))


def test_addresses_too_many_to_broadcast_are_not_copied(spark, monkeypatch):
    table = spark.createDataFrame([(16777216, 33554431, "A")], "start_ip bigint, end_ip bigint, country string")
    ip = F.concat(F.lit("1.2."), (F.col("id") % 50).cast("string"), F.lit(".9"))
    ip = F.when(F.col("id") % 3 == 0, "1.1.1.1").when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, "9.9.9.9").otherwise(ip)
    mails = spark.range(2000).select(F.col("id").alias("msg_id"), ip.alias("originating_ip"))
    few = geo.ip_country(mails, table)
    monkeypatch.setattr(geo, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(geo, "counted_join", lambda *a: joins.counted_join(*a, hot=100))
    many = geo.ip_country(mails, table, rows=0, salts=4)
    assert many.columns == few.columns
    assert sorted(map(tuple, many.collect()), key=repr) == sorted(map(tuple, few.collect()), key=repr)
    text = many._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 31" not in text and "ceil" in text.lower()


def test_ip_country(spark):
    ranges = [(16777216, 16777471, "A"), (16777472, 33554431, "B"), (50331648 + 65530, 50331648 + 65541, None), (167772160, 184549375, "P")]
    table = spark.createDataFrame(ranges, "start_ip bigint, end_ip bigint, country string")
    cases = {
        "1.0.0.0": "A", "1.0.0.255": "A", "1.0.1.0": "B", "1.255.255.255": "B", "2.0.0.0": "N/A", "3.0.255.250": None,
        "3.1.0.5": None, "3.1.0.6": "N/A", "10.1.2.3": "N/A", "": "N/A", None: "N/A", "1.0.0": "N/A", "01.0.0.0": "N/A", "1.0.0.256": "N/A", "x": "N/A",
    }
    mails = spark.createDataFrame([(str(i), ip) for i, ip in enumerate(cases)], "msg_id string, originating_ip string")
    for size in (1000, 0):
        got = {r["originating_ip"]: r["originating_ip_country"] for r in geo.ip_country(mails, table, rows=size).collect()}
        assert got == cases
    assert geo.overlapping_ranges(table).count() == 0
    more = table.union(spark.createDataFrame([(33554000, 33560000, "C")], table.schema))
    assert geo.overlapping_ranges(more).count() == 1
    with pytest.raises(ValueError, match="overlapping"):
        geo.ip_country(mails, more)


def test_mapped_addresses_are_ipv4(spark):
    table = spark.createDataFrame([(16777216, 16777471, "A")], "start_ip bigint, end_ip bigint, country string")
    cases = {"::ffff:1.0.0.1": "A", "::FFFF:1.0.0.255": "A", "::ffff:2.0.0.1": "N/A", "::fffe:1.0.0.1": "N/A"}
    mails = spark.createDataFrame([(i,) for i in cases], "originating_ip string").withColumn("msg_id", F.lit("m"))
    assert dict(map(tuple, geo.ip_country(mails, table).select("originating_ip", "originating_ip_country").collect())) == cases


def test_country_moves_no_body(spark):
    ranges = spark.range(5000).select((F.col("id") * 65536).alias("start_ip"), (F.col("id") * 65536 + 70).alias("end_ip"), F.concat(F.lit("C"), F.col("id")).alias("country"))
    mails = spark.range(2000).select(
        F.concat(F.lit("m"), F.col("id")).alias("msg_id"), F.lit("a long body").alias("mime"),
        F.concat_ws(".", F.floor(F.col("id") / 256).cast("string"), (F.col("id") % 256).cast("string"), F.lit("0"), F.lit("7")).alias("originating_ip"),
    )
    sliced = geo.ip_country(mails, ranges, rows=2000)
    text = plan(sliced)
    assert text.count("BroadcastHashJoin") > 2 and "Exchange hashpartitioning" not in text
    want = sorted(map(tuple, geo.ip_country(mails, ranges).collect()))
    assert sorted(map(tuple, sliced.collect())) == want == sorted(map(tuple, geo.ip_country(mails, ranges, rows=0, salts=3).collect()))
    assert [r for r in want if r[3] == "C300"]


def test_ipv6(spark):
    import ipaddress

    good = ["::", "::1", "1::", "2001:db8::8a2e:370:7334", "2001:DB8:0:0:0:0:2:1", "fe80::1:2:3:4:5:6", "1:2:3:4:5:6:7:8"]
    bad = ["", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "1.2.3.4", "1:2:3:4:5:6:7:8::x", None]
    df = spark.createDataFrame([(x,) for x in good + bad], "ip string")
    got = {r["ip"]: r["h"] for r in df.select("ip", geo.ipv6_hex("ip").alias("h")).collect()}
    assert got == {**{x: f"{int(ipaddress.ip_address(x)):032x}" for x in good}, **dict.fromkeys(bad)}
    wide = [("2" + "0" * 31, "2" + "f" * 31, "W"), ("3001" + "0" * 28, "3001" + "0" * 27 + "5", "N")]
    ranges6 = spark.createDataFrame(wide, "start_ip string, end_ip string, country string")
    mails = spark.createDataFrame([("a", "2a00::1"), ("b", "3001::5"), ("c", "3001::6"), ("d", "1.0.0.1")], "msg_id string, originating_ip string")
    ranges = spark.createDataFrame([(16777216, 16777471, "A")], "start_ip bigint, end_ip bigint, country string")
    for size in (1000, 0):
        out = geo.ip_country(mails, ranges, ranges6, rows=size).collect()
        assert {r["msg_id"]: r["originating_ip_country"] for r in out} == {"a": "W", "b": "N", "c": "N/A", "d": "A"}


def test_histogram_equals_numpy(spark):
    rnd = random.Random(3)
    scores = [round(rnd.random(), 6) for _ in range(2000)] + [1.0, 0.0]
    df = spark.createDataFrame([("a", s) for s in scores] + [("one", 0.25)] * 3 + [("a", None)], "m string, score double")
    got = report.score_histogram(df, ["m"]).orderBy("m", "bin").collect()
    counts, edges = np.histogram(scores, bins=50)
    a = [r for r in got if r["m"] == "a"]
    assert [r["n"] for r in a] == counts.tolist()
    assert np.allclose([r["bin_start"] for r in a], edges[:-1])
    counts, _ = np.histogram([0.25] * 3, bins=50)
    assert [r["n"] for r in got if r["m"] == "one"] == counts.tolist()


@pytest.mark.parametrize("ranges", [None, 1, 5, 64])
def test_row_index_is_global_order(spark, ranges):
    keys = [(f"f{i % 7}", i) for i in range(2000)] + [("hot", i) for i in range(1000)]
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame(keys, "path string, line int").repartition(6)
    got = {(r["path"], r["line"]): r["row_index"] for r in ranking.with_row_index(df, ["path", "line"], ranges=ranges).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_batches(spark):
    df = spark.range(23)
    last = lambda **k: ranking.assign_batches(df, ["id"], 10, **k).orderBy(F.desc("id")).first()["batch_id"]
    assert last() == "20-29"
    assert last(clip=True) == "20-22"


def test_sample_n(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4000, "big").when(F.col("id") < 4990, "mid").otherwise("small").alias("s"))
    one = ranking.sample_n(df, 100, "s", "id", seed=1)
    ids = [r["id"] for r in one.collect()]
    assert len(ids) == len(set(ids)) == 210
    assert dict(map(tuple, one.groupBy("s").count().collect())) == {"big": 100, "mid": 100, "small": 10}
    assert sorted(ids) == sorted(r["id"] for r in ranking.sample_n(df.repartition(7), 100, "s", "id", seed=1).collect())
    other = {r["id"] for r in ranking.sample_n(df, 100, "s", "id", seed=2).collect()}
    assert other != set(ids)
    # a fair draw: the mean id of a set is near its middle
    mean = ranking.sample_n(df, 1000, "s", "id").filter("s = 'big'").agg(F.avg("id")).first()[0]
    assert abs(mean - 2000) < 150


def test_latest_with_text_columns(spark):
    data = [(1, 5, "a"), (1, 9, "b"), (2, 1, "c"), (None, 3, "d"), (3, None, "e"), (4, 2, "f"), (4, 2, "f")]
    df = spark.createDataFrame(data, "user_id int, created_at int, note string")
    assert sorted(map(tuple, ranking.latest_per_user(df).collect())) == [(1, 9, "b"), (2, 1, "c"), (4, 2, "f")]


def test_first_record_aggregates_no_body(spark):
    data = [(1, "f2", 1, "x"), (1, "f1", 9, "y"), (1, "f1", 3, "z"), (2, None, 1, "n"), (2, "a", 1, "o"), (3, "q", 4, "r"), (3, "q", 4, "r")]
    df = spark.createDataFrame(data, "u int, f string, e int, body string")
    out = ranking.first_record_per_user(df, "u", "f", "e")
    assert sorted(map(tuple, out.collect())) == [(1, "f1", 3, "z"), (2, None, 1, "n"), (3, "q", 4, "r")]


def test_broadcast_is_checked_in_bytes(spark):
    df = spark.range(1000).select("id", F.array_repeat(F.lit(1.0), 100).alias("v"), F.repeat(F.lit("x"), 50).alias("s"))
    assert joins.fits_broadcast(df)
    assert not joins.fits_broadcast(df, size=800_000)
    assert not joins.fits_broadcast(df, rows=999)
    assert joins.fits_broadcast(spark.range(0), size=1)
    assert 850_000 < df.agg(F.sum(joins.row_bytes(df))).first()[0] < 1_100_000


def test_null_group_has_its_histogram(spark):
    df = spark.createDataFrame([(None, 0.1), (None, 0.9), ("a", 0.5)], "m string, score double")
    got = report.score_histogram(df, ["m"], bins=4).filter("m IS NULL").orderBy("bin").collect()
    assert [r["n"] for r in got] == [1, 0, 0, 1]


def test_pooling_is_one_scan(spark):
    data = spark.createDataFrame([(1, 0, 1, [1.0]), (1, 1, 1, [3.0])], "doc int, pos int, mask int, vec array<float>")
    path = scratch_path(spark, "tokens")
    data.write.parquet(path)
    tokens = spark.read.parquet(path)
    assert "Exchange" not in plan(E.first_token_pool(tokens))
    assert plan(E.mean_pool(tokens)).count("Scan parquet") == 1
    assert E.mean_pool(tokens).first()["embedding"] == [2.0]


def test_empty_files_add_nothing(spark, tmp_path):
    full, empty = str(tmp_path / "full"), str(tmp_path / "empty")
    spark.range(3).write.parquet(full)
    spark.range(0).write.parquet(empty)
    assert readers.scan_parquet(spark, full, empty).count() == 3
    assert rows.union_frames(spark.read.parquet(full), spark.read.parquet(empty)).count() == 3
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("")
    assert readers.scan_json_lines(spark, str(tmp_path / "lines")).count() == 0


def test_union_checks(spark):
    a = spark.range(1)
    with pytest.raises(ValueError):
        rows.union_frames(a.select("id", F.col("id")))
    with pytest.raises(ValueError):
        rows.assert_has_column(a, "filename")


def test_translate_keeps_failed_texts(spark):
    def fails(texts):
        if "bad" in texts:
            raise RuntimeError
        return [t.upper() for t in texts]

    def short(texts):
        return [t.upper() for t in texts if t != "lost"]

    data = [(1, "good", "fr-ca"), (2, "bad", "fr"), (3, "x", "en"), (4, None, "fr"), (5, "y", None), (6, "lost", "de"), (7, "kept", "de")]
    df = spark.createDataFrame(data, "i int, t string, lang string").coalesce(1).withColumn("s", F.concat(F.lit("s "), "t"))
    out = translate(df, {"fr": lambda: fails, "de": lambda: short}, {"t": "translated_text", "s": "s"})
    got = {r["i"]: r["translated_text"] for r in out.collect()}
    assert got == {1: "GOOD", 2: "bad", 3: "x", 4: None, 5: "y", 6: "lost", 7: "KEPT"}
    assert {r["i"]: r["s"] for r in out.collect()} == {1: "S GOOD", 2: "S BAD", 3: "s x", 4: None, 5: "s y", 6: "S LOST", 7: "S KEPT"}
    assert plan(out).count("ArrowEvalPython") == 1


def test_translators_are_made_in_the_workers(spark, tmp_path):
    def make():
        (tmp_path / f"made-{os.getpid()}").touch()
        return lambda texts: [t + "!" for t in texts]

    df = spark.range(100).select(F.col("id").cast("string").alias("t"), F.lit("fr").alias("lang"))
    assert translate(df, {"fr": make}, {"t": "u"}).filter("u = t || '!'").count() == 100
    assert not (tmp_path / f"made-{os.getpid()}").exists()


def test_bayes_model_is_stored_and_keeps_wordless_classes(spark):
    data = [("good morning", "a"), ("good night", "a"), ("bad bad day", "b"), ("12", "c"), ("lost", None)]
    df = spark.createDataFrame(data, "t string, y string")
    model = fit_bayes(df, "t", "y")
    assert model.classes == ["a", "b", "c"]
    path = scratch_path(spark, "model")
    model.save(path)
    again = load_bayes(path, words)
    assert again.classes == model.classes
    probe = spark.createDataFrame([("good",), ("bad",), ("",)], "t string")
    want = [list(r["p"]) for r in model.probabilities(probe, "t", "p").collect()]
    assert [list(r["p"]) for r in again.probabilities(probe, "t", "p").collect()] == want
    assert [r["n"] for r in again.classify(probe, "t", "n").collect()][:2] == ["a", "b"]
    # 2, 1 and 1 documents, one more for each class
    assert np.allclose(want[2], np.array([3, 2, 2]) / 7)


def test_prior_counts_documents_not_words(spark):
    df = spark.createDataFrame([("w " * 1000, "a")] + [(f"v{i}", "b") for i in range(9)], "t string, y string")
    p = fit_bayes(df, "t", "y").probabilities(spark.createDataFrame([("",)], "t string"), "t", "p").first()["p"]
    assert np.allclose(p, [2 / 12, 10 / 12])


def test_a_rare_term_among_very_many_decides(spark):
    shared = spark.range(60_000).select(F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("w"))
    text = shared.agg(F.array_join(F.collect_list("w"), " ").alias("t"))
    a = text.select(F.concat("t", F.lit(" onlyhere")).alias("t"), F.lit("a").alias("y"))
    b = text.select(F.concat("t", F.lit(" elsewhere")).alias("t"), F.lit("b").alias("y"))
    model = fit_bayes(a.union(b), "t", "y")
    probe = spark.createDataFrame([("onlyhere",), ("elsewhere",)], "t string")
    assert [r["c"] for r in model.classify(probe, "t", "c").collect()] == ["a", "b"]


def test_slots(spark):
    df = spark.createDataFrame([("b b b a a c", "x"), ("c d", "y")], "t string, y string")
    rows = term_counts(df, "t", "y", words).collect()
    assert sorted(tuple(r) for r in rows) == [("x", "a", 2), ("x", "b", 3), ("x", "c", 1), ("y", "c", 1), ("y", "d", 1)]


def test_slots_in_sql_are_those_of_the_model(spark):
    import duckdb

    from mailrisk.plans.standins import slot_sql

    terms = ["", "a", "ab", "abc", "abcd", "abcde", "é", "日本語", "x" * 77, " ab", "ñ 🙂"]
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    vectors = [r["v"] for r in features(df, "t", lambda c: F.array(c), "v").collect()]
    con = duckdb.connect()
    want = [con.execute(f"SELECT {slot_sql('t')} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone()[0] for t in terms]
    assert [int(v.indices[0]) for v in vectors] == want and max(want) < SLOTS


def test_words_are_counted_once_for_all_models(spark):
    from mailrisk.operators import scoring

    df = spark.createDataFrame([("good day", 1), ("bad day", 0), (None, 1)], "t string, y int")
    models = [scoring.bayes_model(f"m{i}", df, "t", "y") for i in range(3)]
    assert len({m.text_col for m in models}) == 1
    together = scoring.score_all(df, models)
    assert plan(together).count("split(lower") == 1
    single = df
    for m in models:
        single = scoring.classify_text(single, m)
    assert together.columns == single.columns and sorted(together.collect(), key=str) == sorted(single.collect(), key=str)


def test_trigrams(spark):
    got = spark.range(1).select(trigrams(F.lit("Ab c,é1"))).first()[0]
    assert got == [" ab", "ab ", " c ", " é "]


def test_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train, rest = docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0")
    out = detect_language(rest, fit_language(train), "text", "found")
    assert out.filter("found = lang").count() >= 0.9 * rest.count()
    empty = spark.createDataFrame([(None,), ("",), ("12 !",)], "text string")
    assert {r["found"] for r in detect_language(empty, fit_language(train), "text", "found").collect()} == {"N/A"}


def _vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return df, np.array([r["embedding"] for r in df.orderBy("id").collect()], dtype=float)


def test_pca_kmeans(spark, sf_dir):
    df, x = _vectors(spark, sf_dir)
    points, centres = E.pca_kmeans(df)
    got = points.orderBy("id").collect()
    centred = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    for name, axis in zip("xy", axes[:2]):
        want = centred @ axis
        have = np.array([r[name] for r in got])
        assert np.allclose(have, want * np.sign(have @ want), atol=1e-6)
    cluster = np.array([r["cluster"] for r in got])
    for c in centres.collect():
        mine = np.array([[r["x"], r["y"]] for r in got])[cluster == c["cluster"]].mean(axis=0)
        assert np.allclose(mine, [c["x"], c["y"]], atol=1e-2)
    again = E.pca_kmeans(df)[0].orderBy("id").collect()
    assert [r["cluster"] for r in again] == cluster.tolist()


def test_mean_pairwise_distance_is_brute_force(spark, sf_dir):
    df, x = _vectors(spark, sf_dir)
    sets = df.withColumn("dataset", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    got = E.mean_pairwise_distance(sets, [("a", "b")]).first()["distance"]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == pytest.approx(np.mean(1 - unit[0::2] @ unit[1::2].T), abs=1e-12)


def test_zero_vector(spark):
    zero, one = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    row = spark.range(1).select(V.unit(zero), V.cosine_similarity(zero, one), V.unit(one), V.cosine_distance(one, one)).first()
    assert list(row) == [[0.0, 0.0], 0.0, [0.6, 0.8], 0.0]


def test_embed_text(spark):
    df = spark.createDataFrame([(0, "a b a"), (1, "c"), (2, ""), (3, None)], "i int, t string")
    got = {r["i"]: r["embedding"] for r in E.embed_text(df, "t").collect()}
    assert all(len(v) == 256 for v in got.values())
    with pytest.raises(ValueError):
        E.embed_text(df, "t", dim=64)
    assert sorted(x for x in got[0] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert sum(got[1]) == pytest.approx(1) and sum(got[2]) == sum(got[3]) == 0


def test_mean_pool_without_kept_token(spark):
    data = [(1, 0, 0, [1.0]), (2, 0, 1, [2.0]), (2, 1, 1, [4.0]), (2, 2, 0, [9.0])]
    df = spark.createDataFrame(data, "doc int, pos int, mask int, vec array<float>")
    assert {r["doc"]: r["embedding"] for r in E.mean_pool(df).collect()} == {1: None, 2: [3.0]}
