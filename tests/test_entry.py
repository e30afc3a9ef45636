"""The entry module used from somewhere else, as a driver program would."""

import os
import subprocess
import sys

from conftest import ROOT, SF_DIR

PROGRAM = """
import importlib.util
from pyspark.sql import SparkSession

spec = importlib.util.spec_from_file_location("entry", "{root}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["extract_messages"](spark, "{sf}").count() > 0)
print("texts", entry.queries()["html_to_text"](spark, "{sf}").filter("text <> ''").count() > 0)
"""


def test_workers_find_the_package_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", PROGRAM.format(root=ROOT, sf=SF_DIR)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert "rows True" in run.stdout and "texts True" in run.stdout, run.stderr[-2000:]
