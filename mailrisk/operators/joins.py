"""Joins that stay whole and balanced whatever the key distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
SALTS = 32
HOT_ROWS = 100_000  # rows of one key that a task takes at most


def _width(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value, nearly."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
            return F.greatest(F.size(c), F.lit(0)) * 8 + 16
        each = F.aggregate(c, F.lit(0), lambda n, x: n + _width(x, kind.elementType).cast("int"))
        return F.coalesce(each, F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind), F.lit(8))
    if isinstance(kind, T.MapType):
        return _width(F.map_keys(c), T.ArrayType(kind.keyType)) + _width(F.map_values(c), T.ArrayType(kind.valueType))
    return F.lit(8)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row in memory, nearly."""
    return sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16))


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a frame is proven small: at most ``rows`` rows and ``size`` bytes.

    Sizes are summed where the rows are: a limit would first bring up to
    ``rows`` rows of every partition to one task.
    """
    seen = df.select(row_bytes(df).alias("_size")).agg(F.count(F.lit(1)), F.sum("_size")).first()
    return seen[0] <= rows and (seen[1] or 0) <= size


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    spread: str,
    how: str = "left",
    rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large frame to a lookup table.

    A lookup of checked size is broadcast, so the large side is not shuffled.
    Beyond that both sides are shuffled on (key, salt): rows of one hot key (or
    of the null key) go to ``salts`` tasks by the hash of ``spread``, and each
    lookup row is repeated once per salt.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(lookup, rows):
        return df.join(F.broadcast(lookup), keys, how)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    # Spark's estimate leaves out the copies, and would broadcast them all where the lookup's files are small
    copies = lookup.withColumn("_salt", F.explode(every)).hint("merge")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def counted_join(
    df: DataFrame, lookup: DataFrame, counts: DataFrame, on: str, spread: str, n: str, hot: int = HOT_ROWS
) -> DataFrame:
    """Left join to a large lookup with one row per key, where ``counts`` has the rows ``n`` of ``df`` with each key.

    Only keys with more than ``hot`` rows are spread over tasks, each over as
    many as its rows need, so all copies together are no more than the rows of
    ``df`` divided by ``hot``; a table of ``SALTS`` copies of every key would be
    larger than ``df``.  Rows without a key go anywhere.
    """
    busy = counts.filter(F.col(n) > hot).select(on, F.ceil(F.col(n) / hot).alias("_parts"))
    few = F.broadcast(busy)  # at most one in ``hot`` of the rows
    parts = F.coalesce("_parts", F.when(F.col(on).isNull(), F.lit(SALTS)), F.lit(1))
    salted = df.join(few, on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts)).drop("_parts")
    every = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1)
    copies = lookup.join(few, on, "left").withColumn("_salt", F.explode(every)).drop("_parts")
    return salted.join(copies, [on, "_salt"], "left").drop("_salt")
