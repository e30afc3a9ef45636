"""Helpers the operators share: stored steps, bounded samples, heavy keys, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.session import scratch_path


def store(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame written to the shared scratch folder and read back.

    Cuts the lineage: what follows survives a lost executor without redoing it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that no name of theirs can meet one an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def columns_of(row: str, names: list[str]) -> list[Column]:
    return [F.col(f"{row}.`{c}`") for c in names]


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer if there is such a column."""
    while name in df.columns:
        name += "_"
    return name


def over_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``fn`` on each Arrow batch of each task; batches without rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def crc_of_id(id_col: str) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string"))


def bounded_sample(df: DataFrame, id_col: str, limit: int) -> DataFrame:
    """At most ``limit`` rows in the order of a hash of their id; all rows if there are no more.

    The threshold comes from the row count, so each task hands over only its
    share.  The same rows whatever the partitions.
    """
    order = F.xxhash64(F.col(id_col).cast("string"))
    total = df.count()
    if total > 2 * limit:
        share = 2.0 * limit / total
        df = df.filter(order < F.lit(int(-(2**63) + share * 2**64)).cast("bigint"))
    return df.orderBy(order, id_col).limit(limit)


#: A key is heavy when it holds at least this share of the rows, so at most 1000 keys are.
HEAVY_SHARE = 0.001


def heavy_join(df: DataFrame, lookup: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Left join to a lookup with one row per key, whatever the key's share of the rows.

    ``rows`` of the lookup says how many rows have the key; it is not returned.
    Rows of heavy keys meet a broadcast of at most 1000 lookup rows and are not
    shuffled; the others are joined by a shuffle in which no key is heavy, never by
    a broadcast: how large they are their files' size does not tell.
    """
    least = max(2.0, HEAVY_SHARE * total)
    heavy = lookup.filter(F.col(rows) >= least).drop(rows)
    light = lookup.filter(F.col(rows) < least).drop(rows)
    names = F.broadcast(heavy.select(key))
    return df.join(F.broadcast(heavy), key).unionByName(df.join(names, key, "left_anti").join(light.hint("merge"), key, "left"))


def _signature(edges: DataFrame) -> tuple:
    pair = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(pair)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u").filter("v > u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are tied to the smallest one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node it reaches.

    Alternating large and small stars: every round shrinks the distance to the
    root by a constant factor.  Edges stay in Spark; each round is stored.
    Null ends and loops are no links.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    edges = store(ends.filter("_a <> _b").select("u", "v").distinct(), "edges")
    before = _signature(edges)
    while before[0]:
        edges = store(_small_star(_large_star(edges)), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()
