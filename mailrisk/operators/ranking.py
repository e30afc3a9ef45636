"""Latest rows, top rows, exact samples and global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailrisk.operators.joins import lookup_join, row_bytes
from mailrisk.session import stored

ROWS_PER_RANGE = 1_000_000
BYTES_PER_RANGE = 128 << 20

_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def latest_per_user(
    df: DataFrame, user: str = "user_id", created: str = "created_at", tie: str | None = None
) -> DataFrame:
    """One row per user: the latest ``created``; with a numeric ``tie`` its smallest value decides.

    Combines on the map side, so a user with very many rows is one partial row
    per task before the shuffle.  Fixed-width columns are taken one by one: the
    aggregate then hashes, where a struct would make it sort its input.  Equal
    times pick the same row for every column, since all see the rows in the
    same order.  With text columns only the times are aggregated, and the rows
    that have them are looked up: texts are neither sorted nor aggregated, but
    for users with several such rows, of which one stays.
    """
    rows = df.filter(F.col(user).isNotNull() & F.col(created).isNotNull())
    others = [c for c in df.columns if c not in (user, created)]
    if tie is None and all(isinstance(df.schema[c].dataType, _FIXED_WIDTH) for c in others):
        latest = [F.max_by(c, created).alias(c) for c in others]
        return rows.groupBy(user).agg(F.max(created).alias(created), *latest).select(df.columns)
    best = rows.groupBy(user).agg(F.max(created).alias(created))
    if tie is not None:
        tied = rows.join(best, [user, created], "left_semi")
        best = tied.groupBy(user, created).agg(F.min(tie).alias(tie))
    return _rows_of(rows, best, user).select(df.columns)


def _rows_of(rows: DataFrame, keys: DataFrame, user: str) -> DataFrame:
    """One of the rows of each user that have the key values of ``keys``; null equals null."""
    named = keys.toDF(*[f"_{c}" for c in keys.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys.columns]
    found = rows.join(named, same, "left_semi")
    return found.dropDuplicates([user])


def latest_per_key_ranked(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """First row per key in an explicit order (the rank filter runs before the shuffle too)."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = df.filter(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(w))
    return ranked.filter("_rank = 1").drop("_rank")


def first_record_per_user(df: DataFrame, user: str, *order: str) -> DataFrame:
    """The row with the smallest ``order`` values of each user, e.g. file then event.

    Only the order columns are aggregated; the whole rows, bodies included, are
    looked up by them.  Of several rows with the same values one stays.
    """
    first = df.groupBy(user).agg(F.min(F.struct(*order)).alias("_first"))
    keys = first.select(user, *[F.col("_first")[c].alias(c) for c in order])
    return _rows_of(df, keys, user).select(user, *[c for c in df.columns if c != user])


def sort_by_score(df: DataFrame, score: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(key))


def top_n(df: DataFrame, n: int, score: str, key: str) -> DataFrame:
    return sort_by_score(df, score, key).limit(n)


def top_n_per_dataset(
    df: DataFrame, n: int = 50, score: str = "score", key: str = "msg_id", by: str = "dataset"
) -> DataFrame:
    """The n best rows of each dataset; each task passes on at most n rows per dataset."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(key))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def sample_n(df: DataFrame, n: int, by: str, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows of each set without replacement, the same ones for the same seed.

    All rows of a set that has fewer than n; rows whose set is null belong to
    none.  ``key`` must be unique in its set.  The order is that of the MD5 of
    key and seed.  A count of hash prefixes finds the prefix the n-th row falls
    in; only the keys of that one prefix are ranked, so no task ever holds a
    set, and the full rows are read once.
    """

    def hashed(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))))

    keys = hashed(df.filter(F.col(by).isNotNull()).select(by, key))
    keys = keys.withColumn("_slot", F.substring("_hash", 1, 4))
    counts = keys.groupBy(by, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    # rows before each slot; at most 16^4 rows per set
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    # the slot with the n-th row; a set without one is taken whole
    edge = before.filter((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n)).drop("_n")
    inside = lookup_join(keys, edge, [by, "_slot"], spread=key, how="inner")
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_hash", key))
    cut = inside.withColumn("_rank", rank).filter(F.col("_rank") == F.lit(n) - F.col("_before"))
    cut = cut.select(by, F.struct("_hash", key).alias("_cut"))
    rows = lookup_join(hashed(df.filter(F.col(by).isNotNull())), cut, by, spread=key)
    taken = F.col("_cut").isNull() | (F.struct("_hash", key) <= F.col("_cut"))
    return rows.filter(taken).select(df.columns)


def range_count(df: DataFrame, rows: int = ROWS_PER_RANGE, size: int = BYTES_PER_RANGE) -> int:
    """Ranges of about ``rows`` rows or ``size`` bytes each, whichever are more."""
    n, width = df.select(row_bytes(df).alias("_size")).agg(F.count(F.lit(1)), F.sum("_size")).first()
    return max(1, -(-n // rows), -(-(width or 0) // size))


def with_row_index(
    df: DataFrame, order_by: list[str], name: str = "row_index", ranges: int | None = None
) -> DataFrame:
    """Zero-based position of each row in the order of ``order_by`` (together unique, not null).

    A plain global ``row_number`` sends everything to one task.  Here rows are
    sorted by range, as many as ``range_count`` says, and stored with
    their place in the range; what is left is to add the rows of the ranges
    before.  The stored table fixes the places, so nothing that is computed
    again later can change a number.
    """
    count = ranges or range_count(df)
    ordered = df.repartitionByRange(count, *order_by).sortWithinPartitions(*order_by)
    # the upper bits of this id are the partition, the lower 33 the place in it
    placed = stored(ordered.withColumn("_place", F.monotonically_increasing_id()), "row-index")
    placed = placed.withColumn("_range", F.shiftright("_place", 33))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one narrow row per range: small even for 10^11 rows
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = lookup_join(placed, starts, "_range", spread="_place", how="inner")
    return numbered.withColumn(name, F.col("_start") + inside).drop("_range", "_place", "_start")


def batch_name(batch_no: Column, size: int, rows: int | None = None) -> Column:
    """``first-last`` of a batch; the last row is nominal unless ``rows`` clips it."""
    first = batch_no * size
    last = first + size - 1
    if rows is not None:
        last = F.least(last, F.lit(rows - 1))
    return F.concat(first.cast("string"), F.lit("-"), last.cast("string"))


def assign_batches(
    df: DataFrame, order_by: list[str], size: int, ranges: int | None = None, clip: bool = False
) -> DataFrame:
    """Consecutive batches of ``size`` rows: ``row_index``, ``batch_no`` and ``batch_id``."""
    rows = df.count() if clip else None
    indexed = with_row_index(df, order_by, ranges=ranges)
    numbered = indexed.withColumn("batch_no", F.floor(F.col("row_index") / size))
    return numbered.withColumn("batch_id", batch_name(F.col("batch_no"), size, rows))


def file_batches(
    df: DataFrame, files_per_batch: int, rows_per_file: int, spread: str, path: str = "s3_path"
) -> DataFrame:
    """Batch of each row by its file: files in name order, a fixed number per batch."""
    files = df.select(path).distinct()
    numbered = with_row_index(files, [path], name="_file")
    size = files_per_batch * rows_per_file
    numbered = numbered.withColumn("batch_no", F.floor(F.col("_file") / files_per_batch))
    numbered = numbered.withColumn("batch_id", batch_name(F.col("batch_no"), size)).drop("_file")
    return lookup_join(df, numbered, path, spread=spread, how="inner")
