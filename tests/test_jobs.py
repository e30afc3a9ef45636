"""Writers, jobs and models that SQL cannot state."""

from types import SimpleNamespace

import pytest
from conftest import plan
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from mailrisk import schema as S
from mailrisk.operators import scoring
from mailrisk.plans import job_queries
from mailrisk.session import scratch_path
from mailrisk.sources import readers, writers
from mailrisk.sources.runs import Output, read_output, run_job
from mailrisk.operators.language import fit_language
from mailrisk.streaming.incremental import ingest_incremental, ingest_new_files

QUERIES = entry.queries()


def test_score_job(spark, sf_dir):
    out = QUERIES["score_job"](spark, sf_dir).cache()
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for m in ("words", "links"):
        assert out.filter(f"{m}_label NOT IN (0, 1) OR {m}_score NOT BETWEEN 0 AND 1").count() == 0
        assert out.filter(f"({m}_label = 1) <> ({m}_score > 0.5) AND {m}_score <> 0.5").count() == 0


def test_logistic_model_learns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = docs.withColumn("y", (F.col("lang") == "en").cast("int"))
    model = scoring.logistic_model("lr", data, "text", "y")
    out = scoring.classify_text(data, model)
    assert out.filter("lr_label = y").count() >= 0.95 * docs.count()


def test_sample_files_reads_only_the_picked(spark, sf_dir):
    path = scratch_path(spark, "files")
    spark.range(1000).repartition(10).write.parquet(path)
    a = readers.sample_files(spark, [path], 4, seed=1)
    assert len(a.inputFiles()) == 4
    assert set(a.inputFiles()) == set(readers.sample_files(spark, [path], 4, seed=1).inputFiles())
    assert readers.sample_files(spark, [path], 99).count() == 1000


def test_scan_day_prunes_partitions(spark):
    path = scratch_path(spark, "days")
    spark.createDataFrame([("m", None, "20240101"), ("n", None, "20240102")], "raw_mime string, event string, day string").select(
        "raw_mime", "day"
    ).write.partitionBy("day").json(path)
    df = readers.scan_day(spark, path, "20240102")
    assert [(r["raw_mime"], r["day"]) for r in df.collect()] == [("n", "20240102")]
    assert all("/day=20240102/" in f for f in df.inputFiles())


def test_write_per_user_splits_a_hot_user(spark):
    path = scratch_path(spark, "users")
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("user_id"), F.col("id").alias("sg_event_id"))
    writers.write_per_user(df, path, partitions=8)
    hot = spark.read.parquet(f"{path}/user_id=1")
    assert len(hot.inputFiles()) > 2
    ids = [r["sg_event_id"] for f in sorted(hot.inputFiles()) for r in spark.read.parquet(f).collect()]
    assert ids == list(range(3000))


def test_csv_round_trip_keeps_cells(spark):
    path = scratch_path(spark, "csv")
    rows = [(0, None), (1, 'a "b"\nc, d\\ e'), (2, ""), (3, " x "), (4, "\\"), (5, 'q\\"')]
    df = spark.createDataFrame(rows, "id int, t string")
    writers.write_csv(df, path)
    assert sorted(map(tuple, readers.scan_csv(spark, path, df.schema).collect())) == rows


def test_map_in_one_pretty_file(spark, tmp_path):
    (tmp_path / "map.json").write_text('{\n "a.html": "1",\n "b.html": "2"\n}')
    got = readers.scan_map(spark, str(tmp_path), whole_file=True)
    assert sorted(map(tuple, got.collect())) == [("a.html", "1"), ("b.html", "2")]


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("7\n\n  8\t\n \n9")
    assert sorted(r[0] for r in readers.scan_id_list(spark, str(tmp_path)).collect()) == ["7", "8", "9"]


def test_resumable_write_adds_each_source_once(spark):
    path = scratch_path(spark, "out")
    df = spark.range(100).select("id", F.concat(F.lit("f"), F.col("id") % 5).alias("s3_path"))
    assert writers.write_resumable(spark, df.filter("s3_path < 'f2'"), path, "id") == 2
    assert writers.write_resumable(spark, df, path, "id") == 3
    assert writers.write_resumable(spark, df, path, "id") == 0
    assert writers.read_resumable(spark, path).count() == 100


def test_half_written_run_does_not_count(spark):
    path = scratch_path(spark, "out")
    df = spark.range(100).select("id", F.concat(F.lit("f"), F.col("id") % 5).alias("s3_path"))
    assert writers.write_resumable(spark, df.filter("s3_path < 'f2'"), path, "id") == 2
    # a run that wrote some rows of two sources and never got to its manifest
    df.filter("s3_path >= 'f3' AND id < 50").write.parquet(f"{path}/run=lost")
    assert writers.read_resumable(spark, path).count() == 40
    assert writers.write_resumable(spark, df, path, "id") == 3
    assert sorted(r["id"] for r in writers.read_resumable(spark, path).collect()) == list(range(100))


def test_source_without_rows_left_is_done(spark):
    path = scratch_path(spark, "out")
    df = spark.range(20).select("id", F.concat(F.lit("f"), F.col("id") % 2).alias("s3_path"))
    keep = lambda rows: rows.filter("s3_path = 'f0'")
    assert writers.write_resumable(spark, df, path, "id", transform=keep) == 2
    assert writers.write_resumable(spark, df, path, "id", transform=keep) == 0
    assert writers.read_resumable(spark, path).count() == 10


def test_user_folder_that_is_no_number(spark, tmp_path):
    for name in ("7", "someone"):
        (tmp_path / "users" / name).mkdir(parents=True)
        (tmp_path / "users" / name / "a.json").write_text('{"raw_mime": "x"}\n')
    got = readers.scan_user_json(spark, str(tmp_path / "users")).collect()
    assert sorted((r["path_user"] for r in got), key=str) == [7, None]


def test_map_line_that_does_not_parse_fails(spark, tmp_path):
    (tmp_path / "map.json").write_text('{\n "a.html": "1",\n "b.html": "2"\n}')
    with pytest.raises(Exception, match="no JSON object"):
        readers.scan_map(spark, str(tmp_path)).collect()


def test_bad_records_keep_what_was_read(spark, tmp_path):
    lines = ['{"raw_mime": "b", "event": {"payload": {"msgid": "1"}}}', '{"raw_mime": "x"}', '{"event": {"payload": {"msgid": "2"}}}', "{broken"]
    (tmp_path / "a.json").write_text("\n".join(lines))
    good, bad = readers.split_bad_records(readers.scan_json_lines(spark, str(tmp_path)))
    assert good.count() == 1
    got = {r["reason"]: r["record"] for r in bad.collect()}
    assert got == {
        "missing event.payload": '{"raw_mime":"x"}',
        "missing raw_mime": '{"event":{"payload":{"msgid":"2"}}}',
        "unreadable line": "{broken",
    }


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from mailrisk import session

    assert session.runs_here("local") and session.runs_here("local[8]")
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077", "k8s://x"):
        assert not session.runs_here(master)
    settings: dict[str, str] = {}
    cluster = SimpleNamespace(conf=settings, sparkContext=SimpleNamespace(master="yarn", applicationId="app"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(cluster)
    settings["spark.checkpoint.dir"] = "hdfs://store/scratch/"
    assert session.scratch_root(cluster) == "hdfs://store/scratch"


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    from mailrisk import session

    monkeypatch.setattr(session, "_made", {})
    monkeypatch.setattr(session, "scratch_root", lambda spark: str(tmp_path))
    kept = session.stored(spark.range(3), "step")
    assert kept.count() == 3 and len(list(tmp_path.iterdir())) == 1
    assert session.clear_scratch(spark) == 1 and not list(tmp_path.iterdir())


def test_more_batches_than_progress_reports(spark):
    base = scratch_path(spark, "many")
    spark.range(110).repartition(110, "id").write.option("maxRecordsPerFile", 1).json(f"{base}/in")
    files = spark.read.schema("id bigint").json(f"{base}/in").inputFiles()
    assert len(files) >= 110
    got = ingest_new_files(
        spark, f"{base}/in", f"{base}/out", f"{base}/ck", lambda df: df, schema=spark.range(0).schema, files_per_batch=1
    )
    assert got == len(files)
    assert spark.read.parquet(f"{base}/out").count() == 110


def test_ingest_keeps_broken_lines_and_messages(spark, sf_dir, tmp_path):
    event = '"event": {"payload": {"userid": 1, "msgid": "%s", "subject": "%s", "originating_ip": "1.0.0.1"}}'
    lines = [
        '{"raw_mime": "Content-Type: text/html\\n\\n<p>hi</p>", ' + event % ("a", "good day") + "}",
        '{"raw_mime": "Content-Type: text/plain\\n\\nplain", ' + event % ("b", "bad =?x-none?B?AAAA?=") + "}",
        "{broken",
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ranges = spark.createDataFrame([(16777216, 16777471, "A")], "start_ip bigint, end_ip bigint, country string")
    out = str(tmp_path / "out")
    run = dict(source=str(tmp_path / "in"), target=out, checkpoint=str(tmp_path / "ck"), ranges=ranges, language=fit_language(docs))
    assert ingest_incremental(spark, **run) == 1
    mails = spark.read.parquet(f"{out}/mails").collect()
    assert [(r["msg_id"], r["originating_ip_country"], r["email_text"]) for r in mails] == [("a", "A", "hi")]
    assert [r["html"] for r in spark.read.parquet(f"{out}/html").collect()] == ["<p>hi</p>"]
    held = {r["record"][:8]: r["reason"] for r in spark.read.parquet(f"{out}/quarantine").collect()}
    assert len(held) == 2 and held["{broken"] == "unreadable line"
    assert all(f.endswith(".zstd.parquet") for t in ("parsed", "mails", "html") for f in spark.read.parquet(f"{out}/{t}").inputFiles())


def test_json_lines_are_small_gzip_files(spark):
    path = scratch_path(spark, "lines")
    df = spark.range(250).select("id", F.repeat(F.lit("body "), 100).alias("text")).coalesce(1)
    writers.write_json_lines(df, path, records=100)
    back = spark.read.schema("id bigint, text string").json(path)
    files = back.inputFiles()
    assert len(files) == 3 and all(f.endswith(".json.gz") for f in files)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_ranges_are_bounded_in_bytes(spark, monkeypatch):
    from mailrisk.operators import ranking

    path = scratch_path(spark, "wide")
    df = spark.range(4000).select("id", F.repeat(F.col("id").cast("string"), 300).alias("text"))
    assert ranking.range_count(df) == 1
    assert ranking.range_count(df, rows=1000) == 4
    assert ranking.range_count(df, size=1 << 20) >= 4
    monkeypatch.setattr(writers, "range_count", lambda df: ranking.range_count(df, size=1 << 20))
    writers.write_csv(df, f"{path}/sheet", number_by=["id"])
    sheet = readers.scan_csv(spark, f"{path}/sheet", T.StructType([T.StructField("row", T.LongType()), *df.schema]))
    assert len(sheet.inputFiles()) >= 4 and sheet.filter("row = id").count() == 4000
    writers.write_batches(df, f"{path}/batches", ["id"], 300)
    assert len(spark.read.parquet(f"{path}/batches").inputFiles()) > 14  # one range would make one file for each of the 14


def test_jobs_use_small_arrow_batches(spark):
    from mailrisk.session import small_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    path = scratch_path(spark, "batches")

    def sizes(todo, _done):
        return todo.mapInPandas(lambda frames: (f.assign(id=len(f)) for f in frames), "id bigint, s3_path string")

    try:
        for setting, longest in (("10000", 1000), ("50", 50)):
            spark.conf.set(name, setting)
            df = spark.range(0, 3000, 1, 1).select("id", F.lit(f"f{setting}").alias("s3_path"))
            run_job(df, f"{path}/{setting}", [Output("sizes", sizes)], spread="id")
            assert read_output(spark, f"{path}/{setting}", "sizes").agg(F.max("id")).first()[0] == longest
            assert spark.conf.get(name) == setting
        with pytest.raises(ValueError), small_batches(spark):
            raise ValueError
        assert spark.conf.get(name) == "50"
    finally:
        spark.conf.set(name, before)


def test_per_user_write_uses_every_core(spark):
    path = scratch_path(spark, "users")
    df = spark.range(4000).select(F.col("id").alias("user_id"), F.col("id").alias("sg_event_id"))
    writers.write_per_user(df.filter("user_id < 200"), path, partitions=2)
    tasks = {f.rsplit("/part-", 1)[1][:5] for f in spark.read.parquet(path).inputFiles()}
    assert len(tasks) > spark.sparkContext.defaultParallelism


def test_incremental_ingest(spark):
    base = scratch_path(spark, "inc")
    run = dict(source=f"{base}/in", target=f"{base}/out", checkpoint=f"{base}/ck", transform=lambda df: df, schema=spark.range(0).schema)
    spark.range(10).coalesce(1).write.mode("append").json(f"{base}/in")
    assert ingest_new_files(spark, **run) == 1
    spark.range(10, 15).coalesce(1).write.mode("append").json(f"{base}/in")
    assert ingest_new_files(spark, **run) == 1
    assert ingest_new_files(spark, **run) == 0
    assert sorted(r["id"] for r in spark.read.parquet(f"{base}/out").collect()) == list(range(15))


def test_raw_schema_reads_nested_and_dotted_names():
    assert S.RAW_EVENT["event"].dataType["payload"].dataType == S.PAYLOAD
    assert "event.payload.from" in S.RAW_EVENT_FLAT.names


NO_LOOPS = ["suspension_window", "suspension_window_salted", "ip_country", "ip_country_salted", "mean_pairwise_distance", "centroid_similarity"]
NATIVE = ["clean_email_text", "url_domains", "subject_body", "softmax", "score_four_class", "prompt_answer_flags", "majority_vote", "flag_share"]


@pytest.mark.parametrize("name", NO_LOOPS)
def test_no_nested_loops(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_native_expressions(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "Arrow" not in text


def test_top_n_limits_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["top_n_per_dataset"](spark, sf_dir))
    assert "TakeOrderedAndProject" in plan(QUERIES["top_n"](spark, sf_dir))


def test_suspended_users_hash(spark, sf_dir):
    text = plan(QUERIES["suspended_users"](spark, sf_dir))
    assert "SortAggregate" not in text


def test_window_prunes_the_mail_history(spark, sf_dir):
    assert "GreaterThan(email_date" in plan(_window(spark))


def _window(spark):
    import datetime as dt

    from mailrisk.operators import cohort

    path = scratch_path(spark, "mails")
    days = spark.range(40).select((F.col("id") % 3).alias("user_id"), "id", F.expr("cast(timestamp'2024-01-01' + make_interval(0,0,0,cast(id AS int)) AS timestamp_ntz)").alias("email_date"))
    days.write.parquet(path)
    suspended = spark.createDataFrame([(1, dt.datetime(2024, 1, 20))], "user_id bigint, created_at timestamp_ntz")
    return cohort.suspension_window(spark.read.parquet(path), suspended, spread="id")


def test_scan_reads_needed_columns_only(spark, sf_dir):
    text = plan(QUERIES["emails_per_user"](spark, sf_dir))
    assert "ReadSchema: struct<user_id:bigint>" in text
    text = plan(QUERIES["recent_notes"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts" in text and "StringContains(event_type,err)" in text


def test_bodies_of_an_ingest_are_not_broadcast(spark, sf_dir, tmp_path):
    """Equal bodies leave small files, from which Spark would take the table for small."""
    body = "<p>" + "word " * 200 + "</p>"
    mails = spark.range(2000).select(F.col("id").cast("string").alias("msg_id"), *[F.lit("x").alias(c) for c in job_queries._MAIL if c not in ("msg_id", "html")])
    mails.write.parquet(f"{tmp_path}/mails")
    mails.filter("msg_id % 2 = 0").select("msg_id", F.lit(body).alias("html")).write.parquet(f"{tmp_path}/html")
    mails.limit(0).write.parquet(f"{tmp_path}/quarantine")
    found = job_queries._ingested(spark, str(tmp_path))
    assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
    assert found.count() == 2000 and found.filter(F.col("html") == body).count() == 1000
    raw = job_queries._raw_documents(spark, sf_dir)
    assert "SortMergeJoin" in plan(raw) and "Broadcast" not in plan(raw)
