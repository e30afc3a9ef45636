"""Scans.  Every reader declares its schema and stays lazy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailrisk import schema as S
from mailrisk.functions import text as X

CORRUPT = "_corrupt_record"


def with_source_path(df: DataFrame, name: str = "s3_path") -> DataFrame:
    """Add the file each row came from; use directly on a file scan."""
    return df.select("*", F.col("_metadata.file_path").alias(name))


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than there are cores one partition per core.

    For work that is heavy per row (parsing messages, fitting and applying text
    models) on few or unsplittable files.  A scan that already has splits enough
    is returned as it is, so a large table is never shuffled for this.  Only for
    frames straight off a scan: counting their splits runs no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def scan_json_lines(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = S.RAW_EVENT,
    partitions: int | None = None,
) -> DataFrame:
    """JSON lines, plain or gzip.  Lines that do not parse land in ``_corrupt_record``.

    A gzip file is one split however big it is; ``partitions`` spreads its rows
    before expensive work such as parsing messages.
    """
    paths = [path] if isinstance(path, str) else list(path)
    full = T.StructType(list(schema) + [T.StructField(CORRUPT, T.StringType())])
    df = (
        spark.read.schema(full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(paths)
    )
    df = with_source_path(df)
    return df.repartition(partitions) if partitions else df


def scan_user_json(
    spark: SparkSession, path: str, schema: T.StructType = S.RAW_EVENT
) -> DataFrame:
    """``users/<uid>/<file>.json`` trees; ``path_user`` is the id in the path, null if it is no number."""
    full = T.StructType(list(schema) + [T.StructField(CORRUPT, T.StringType())])
    df = (
        spark.read.schema(full)
        .option("recursiveFileLookup", "true")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    df = with_source_path(df)
    return df.withColumn("path_user", X.user_from_path("s3_path").try_cast("bigint"))


def scan_day(
    spark: SparkSession, root: str, day: str, schema: T.StructType = S.RAW_EVENT
) -> DataFrame:
    """One ``day=YYYYMMDD`` folder below ``root``; no other folder is listed."""
    full = T.StructType(
        list(schema) + [T.StructField(CORRUPT, T.StringType()), T.StructField("day", T.StringType())]
    )
    reader = spark.read.schema(full).option("columnNameOfCorruptRecord", CORRUPT)
    return with_source_path(reader.option("basePath", root).json(f"{root.rstrip('/')}/day={day}"))


def scan_parquet(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """One or many files or folders as one frame, Parquet files only."""
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(*paths)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """Headered CSV whose cells may hold quotes and line breaks."""
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("multiLine", "true")
        .option("quote", '"')
        .option("escape", '"')
        # an empty cell is null and a quoted empty cell is "": no text may stand for null
        .option("nullValue", "\x00")
        .options(**options)
        .csv(path)
    )


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def scan_warehouse(
    spark: SparkSession, sql: str, jdbc: dict[str, str] | None = None
) -> DataFrame:
    """Result of a SQL text with lower-case column names.

    With ``jdbc`` options (url, driver, user, ...) the text runs on that
    database; otherwise on the tables of the Spark catalog.
    """
    if jdbc:
        return lower_columns(spark.read.format("jdbc").options(**jdbc).option("query", sql).load())
    return lower_columns(spark.sql(sql))


def scan_id_list(spark: SparkSession, path: str, name: str = "user_id") -> DataFrame:
    """One id per line; blank lines do not count."""
    lines = spark.read.text(path).select(X.strip("value").alias(name))
    return lines.filter(F.col(name) != "")


def scan_map(
    spark: SparkSession,
    path: str,
    key: str = "filename",
    value: str = "file_id",
    whole_file: bool = False,
) -> DataFrame:
    """JSON objects as a two-column lookup; anything else but a blank line ends the job.

    One object per line by default, so that a large map can be split over many
    lines and files; ``whole_file`` reads each file as one pretty-printed object.
    """
    lines = spark.read.text(path, wholetext=whole_file).filter(X.strip("value") != "")
    entries = F.from_json("value", "map<string,string>")
    why = F.concat(F.lit("no JSON object: "), F.substring("value", 1, 200))
    whole = F.when(entries.isNotNull(), entries).otherwise(F.raise_error(why).cast("map<string,string>"))
    return lines.select(F.explode(whole).alias(key, value))


def scan_embeddings(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(S.EMBEDDING_SET).parquet(*paths)


def sample_files(
    spark: SparkSession, paths: Sequence[str], k: int, seed: int = 42
) -> DataFrame:
    """All rows of ``k`` Parquet files picked at random below ``paths``; files without rows are never picked.

    Tasks read no column, only how many rows a file has, and each hands over its
    ``k`` first names by hash: the files that are not picked are never read, and
    only ``k`` names come to the driver.
    """
    listing = scan_parquet(spark, *paths)
    parts = [scan_parquet(spark, p).select(F.lit(i).alias("at"), F.col("_metadata.file_path").alias("path")) for i, p in enumerate(paths)]
    files = reduce(DataFrame.union, parts).groupBy("path").agg(F.min("at").alias("at"))
    picked = files.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(k).collect()
    found = []
    for i in sorted({r["at"] for r in picked}):
        names = sorted(r["path"] for r in picked if r["at"] == i)
        reader = spark.read.schema(listing.schema)
        if any("=" in n.rsplit("/", 2)[-2] for n in names):
            reader = reader.option("basePath", paths[i])  # folder names stay columns
        found.append(reader.parquet(*names))
    return reduce(DataFrame.union, found) if found else listing.limit(0)


def split_bad_records(
    df: DataFrame, required: Sequence[str] = ("raw_mime", "event.payload")
) -> tuple[DataFrame, DataFrame]:
    """(good, bad): a record is whole or it goes to the bad side, with its raw line or,
    where the line could be read, with all that was read of it.

    Spark does not answer a filter on the corrupt column alone over a raw JSON
    scan; the ``required`` fields keep data columns in it.
    """
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    reason = F.coalesce(F.when(F.col(CORRUPT).isNotNull(), F.lit("unreadable line")), *missing)
    good = df.filter(reason.isNull()).drop(CORRUPT)
    bad = df.filter(reason.isNotNull())
    read = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (CORRUPT, "s3_path", "day", "path_user")]))
    return good, bad.select(F.coalesce(CORRUPT, read).alias("record"), "s3_path", reason.alias("reason"))
