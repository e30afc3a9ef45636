"""Sinks."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.functions import text as X
from mailrisk.operators.joins import lookup_join
from mailrisk.operators.ranking import assign_batches, range_count, with_row_index
from mailrisk.session import stored


# Bodies are most of what a job leaves on disk; Zstandard takes about half the room of the default codec.
CODEC = "zstd"


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", CODEC).parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite", records: int = 20_000) -> None:
    """Gzip JSON lines; a file that cannot be split has at most ``records`` of them."""
    df.write.mode(mode).option("compression", "gzip").option("maxRecordsPerFile", records).json(path)


def write_csv(
    df: DataFrame, path: str, mode: str = "overwrite", number_by: list[str] | None = None, **options: str
) -> None:
    """Headered CSV; cells with quotes or line breaks read back unchanged.

    With ``number_by`` the first column, ``row``, is the place of the row in that
    order, from 0, and the files follow each other in it.  A file with line
    breaks in its cells is read by one task, so files are ranges of limited size.
    """
    if number_by:
        df = stored(df, "unnumbered")  # read to be sized, to find the ranges and to be sorted
        ranges = range_count(df)
        numbered = with_row_index(df, number_by, "row", ranges)
        ranged = numbered.repartitionByRange(ranges, "row").sortWithinPartitions("row")
        df = ranged.select("row", *[F.col(f"`{c}`") for c in df.columns])
    (
        df.write.mode(mode)
        .option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .options(**options)
        .csv(path)
    )


def write_per_user(
    df: DataFrame,
    path: str,
    user: str = "user_id",
    order: str = "sg_event_id",
    fmt: str = "parquet",
    partitions: int | None = None,
) -> None:
    """One folder per user, rows ordered by event id inside each.

    Rows are ranged on (user, event), not hashed on the user, so a user with a
    third of all mail is cut into many tasks; its files follow each other in
    event order.  There are as many ranges as ``range_count`` says, but at least
    ``partitions``, and two per core: making the files of all users takes far
    longer than sorting the rows, so no core may stand idle.
    """
    keys = [F.col(user), F.col(order)]
    cores = df.sparkSession.sparkContext.defaultParallelism
    ranged = df.repartitionByRange(max(partitions or 1, 2 * cores, range_count(df)), *keys)
    writer = ranged.sortWithinPartitions(user, order).write.mode("overwrite").partitionBy(user)
    if fmt == "csv":
        writer.option("header", "true").option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_batches(df: DataFrame, path: str, order_by: list[str], size: int) -> None:
    """Folders ``batch_id=<first>-<last>`` of ``size`` consecutive rows each."""
    ranges = range_count(df)
    batched = assign_batches(df, order_by, size, ranges)
    (
        batched.repartitionByRange(ranges, "batch_no", "row_index")
        .sortWithinPartitions("batch_no", "row_index")
        .drop("batch_no", "row_index")
        .write.mode("overwrite")
        .partitionBy("batch_id")
        .parquet(path)
    )


def html_bodies(df: DataFrame, html: str = "html", msg_id: str = "msg_id") -> DataFrame:
    """Messages that have HTML, with the key their body is stored under."""
    body = F.col(html)
    return df.filter(body != "").select(
        F.col(msg_id).alias("msg_id"), X.html_key(msg_id).alias("html_key"), body.alias("html")
    )


def write_html_bodies(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table keyed by message: one object per mail would be a small file each."""
    write_parquet(html_bodies(df), path, mode)


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _manifest(path: str) -> str:
    return f"{path}/_manifest"  # Spark does not take a folder of such a name for data


def pending_sources(
    spark: SparkSession, df: DataFrame, path: str, spread: str, source: str = "s3_path"
) -> DataFrame:
    """Rows of ``df`` whose source the manifest at ``path`` does not list as done."""
    done = read_if_exists(spark, _manifest(path))
    if done is None:
        return df
    return lookup_join(df, done.select(source).distinct(), source, spread=spread, how="left_anti")


def write_resumable(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    spread: str,
    source: str = "s3_path",
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Write the rows of sources not done before; returns how many sources that were.

    Each run writes a folder of its own and, after that is committed, lists its
    sources in the manifest; a run that is lost half way is in no manifest, so
    its rows do not count and its sources are done again.  ``transform`` may
    drop rows: a source is done even if none of its rows is left.  Read the
    rows with ``read_resumable``.
    """
    todo = pending_sources(spark, df, path, spread, source)
    sources = todo.select(source).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    remaining = sources.count()
    if remaining:
        run = uuid4().hex
        rows = transform(todo) if transform else todo
        rows.write.parquet(f"{path}/run={run}")
        sources.withColumn("run", F.lit(run)).write.mode("append").parquet(_manifest(path))
    sources.unpersist()
    return remaining


def read_resumable(spark: SparkSession, path: str) -> DataFrame:
    """All rows of completed runs."""
    done = read_if_exists(spark, _manifest(path))
    if done is None:
        raise FileNotFoundError(f"no completed run below {path}")
    runs = [r["run"] for r in done.select("run").distinct().collect()]  # one per run ever made
    return spark.read.parquet(*[f"{path}/run={r}" for r in sorted(runs)])
