"""Prompted models, and jobs whose outputs count together or not at all."""

import os
from pathlib import Path
from uuid import uuid4

import pytest
from conftest import plan
from pyspark.sql import functions as F

from mailrisk.operators import scoring
from mailrisk.plans import jobs
from mailrisk.sources import runs
from mailrisk.sources.runs import Output, read_output, run_job


def generator(folder, answers):
    def make():
        Path(folder, f"{os.getpid()}-{uuid4().hex}").touch()
        return lambda prompts, samples: [list(answers)[:samples] for _ in prompts]

    return make


def test_generator_is_loaded_once_in_each_worker(spark, tmp_path):
    df = spark.range(400).select(F.col("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("t")).repartition(24)
    model = scoring.prompted_model("m", "t", generator(tmp_path, ["TRUE"] * 5), batch_size=4)
    scored = scoring.classify_text(df, model)
    assert scored.agg(F.sum("m_label"), F.sum("m_score")).first()[:] == (400, 400.0)
    pids = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert len(pids) == len(set(pids)) and pids  # 100 batches and 24 tasks


@pytest.mark.parametrize(
    "answers, label, score",
    [
        (["TRUE", "true.", "False", "no true", "x"], 1, 0.6),
        (["TRUE", "FALSE"], 0, 0.5),
        (["p<<ANSWER>>: TRUE<<ANSWER>>: false"], 0, 0.0),
        (["TRUE text <<ANSWER>>:", "", "true", "True"], 0, 0.5),
    ],
)
def test_votes(spark, tmp_path, answers, label, score):
    df = spark.createDataFrame([(1, "a %s text"), (2, None)], "id int, t string")
    model = scoring.prompted_model("m", "t", generator(tmp_path, answers), samples=len(answers))
    assert [tuple(r) for r in scoring.classify_text(df, model).select("m_label", "m_score").collect()] == [(label, score)] * 2


def test_a_generator_must_answer_every_prompt(spark, tmp_path):
    df = spark.range(3).select(F.lit("a").alias("t"))
    model = scoring.prompted_model("m", "t", generator(tmp_path, ["TRUE"]), samples=2)
    with pytest.raises(Exception, match="must give 2 answers"):
        scoring.classify_text(df, model).collect()


def rows(spark, low, high):
    return spark.range(low, high).select("id", F.concat(F.lit("in/"), (F.col("id") % 4).cast("string")).alias("s3_path"))


class Lost(Exception):
    pass


def test_a_run_lost_between_two_outputs_is_done_again_as_a_whole(spark, tmp_path):
    path, lose = str(tmp_path / "out"), [True]

    def second(_todo, done):
        if lose[0]:
            raise Lost
        return done["one"].groupBy("s3_path").agg(F.sum("twice").alias("total"))

    outputs = [Output("one", lambda todo, _: todo.withColumn("twice", F.col("id") * 2)), Output("two", second)]
    df = rows(spark, 0, 40)
    with pytest.raises(FileNotFoundError):
        read_output(spark, path, "one")
    with pytest.raises(Lost):
        run_job(df, path, outputs, spread="id")
    assert len(list((tmp_path / "out" / "one").iterdir())) == 1  # written, but in no manifest
    with pytest.raises(FileNotFoundError):
        read_output(spark, path, "one")
    lose[0] = False
    assert run_job(df.filter("s3_path < 'in/2'"), path, outputs, spread="id") == 2
    lose[0] = True
    with pytest.raises(Lost):
        run_job(df, path, outputs, spread="id")
    assert read_output(spark, path, "one").count() == 20
    lose[0] = False
    assert run_job(df, path, outputs, spread="id") == 2
    assert run_job(df, path, outputs, spread="id") == 0
    assert sorted(r["id"] for r in read_output(spark, path, "one").collect()) == list(range(40))
    want = {f"in/{k}": sum(2 * i for i in range(40) if i % 4 == k) for k in range(4)}
    assert {r["s3_path"]: r["total"] for r in read_output(spark, path, "two").collect()} == want


def test_a_job_that_dies_while_it_writes_scores(spark, tmp_path, monkeypatch):
    mails = rows(spark, 0, 12).withColumns({"subject": F.lit("hi"), "email_text": F.concat(F.lit("text "), F.col("id").cast("string"))})
    mails = mails.withColumnRenamed("id", "msg_id")
    model, path = scoring.prompted_model("m", "translated_text", generator(tmp_path, ["TRUE"] * 5)), str(tmp_path / "scores")
    real = runs._write

    def dying(df, folder, output):
        if output.name == "figures":
            raise Lost
        return real(df, folder, output)

    monkeypatch.setattr(runs, "_write", dying)
    with pytest.raises(Lost):
        jobs.write_scores(mails, [model], path)
    monkeypatch.undo()
    assert jobs.write_scores(mails, [model], path) == 4
    assert read_output(spark, path, "scores").filter("m_label = 1").count() == 12
    assert read_output(spark, path, "figures").select("n_rows", "n_phish").collect() == [(12, 12)]


def test_csv_output_reads_back(spark, tmp_path):
    path = str(tmp_path / "out")
    odd = ['a "quoted", cell', "two\nlines", "", None, " blanks ", "\\n"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(odd)], "id long, t string, s3_path string")
    df = df.withColumn("at", F.lit("2024-01-02 03:04:05.678901").cast("timestamp_ntz"))
    outputs = [Output("sheet", lambda todo, _: todo.drop("s3_path"), csv=True, number_by=("id",))]
    assert run_job(df, path, outputs, spread="id") == 1
    schema = spark.createDataFrame([], "row long, id long, t string, at timestamp_ntz").schema
    found = read_output(spark, path, "sheet", schema).orderBy("row").collect()
    assert [r["t"] for r in found] == odd and [r["row"] for r in found] == list(range(len(odd)))
    assert {str(r["at"]) for r in found} == {"2024-01-02 03:04:05.678901"}


def test_run_ids_are_not_collected(spark, tmp_path):
    path = str(tmp_path / "out")
    assert run_job(rows(spark, 0, 8), path, [Output("one", lambda todo, _: todo)], spread="id") == 4
    assert "dynamicpruning" in plan(read_output(spark, path, "one"))
