"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for mail-sized rows.  Skew handling, coalescing and
# run-time broadcast are left to adaptive execution.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # one raw message can be megabytes: keep Arrow batches small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.ui.enabled": "false",
}

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()
_made: dict[str, list[str]] = {}


def build_session(app: str = "mailrisk", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, once.

    They import its batch functions by name; without this only workers that
    happen to run in the source folder, or have it installed, could.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="mailrisk-package-")) / f"{here.name}.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, source.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(bundle))
    _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach: what ``spark.checkpoint.dir`` names.

    Where that is unset, a temporary folder stands in, but only if the executors
    are threads of this process; it goes when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not runs_here(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="mailrisk-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


def runs_here(master: str) -> bool:
    """Whether executors share the driver's process, and so its disk."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder."""
    path = f"{scratch_root(spark)}/{name}-{uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this application put in the scratch folder; returns how many tables that were.

    For the end of a job, when nothing will read a stored step again.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches no longer than ``SETTINGS`` says, for sessions that were built without it.

    A Python worker holds a batch several times over; with the default of 10,000
    rows its memory grows with the table until batches of whole bodies are full.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= int(SETTINGS[name]):
        spark.conf.set(name, SETTINGS[name])
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the scratch folder: computed once, and not again if an executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
