"""Projections, filters, unions and row checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.functions import text as X

# Raw payload field -> mail column (fixed values).
_PAYLOAD_NAMES = {
    "userid": "user_id",
    "msgid": "msg_id",
    "sg_event_id": "sg_event_id",
    "subject": "subject",
    "from": "email_from",
    "email": "email_to",
    "date": "email_date",
    "originating_ip": "originating_ip",
}


def flatten_event(df: DataFrame) -> DataFrame:
    """Nested or dotted raw events to mail columns; an empty subject becomes null."""
    dotted = "event.payload.userid" in df.columns
    cols: list[Column] = []
    for field, name in _PAYLOAD_NAMES.items():
        source = F.col(f"`event.payload.{field}`" if dotted else f"event.payload.`{field}`")
        if name == "subject":
            source = F.nullif(source, F.lit(""))
        cols.append(source.alias(name))
    cols.append(F.col("raw_mime").alias("mime"))
    kept = [F.col(c) for c in ("s3_path", "day", "path_user") if c in df.columns]
    return df.select(*cols, *kept)


def null_defaults(df: DataFrame, *columns: str, default: str = "") -> DataFrame:
    """Rows that hold anything at all, with ``default`` for missing text."""
    return df.dropna(how="all").fillna(default, subset=list(columns))


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def drop_matching(df: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Drop by name ending, e.g. every ``_label`` and ``_score`` column."""
    return df.drop(*[c for c in df.columns if c.endswith(suffixes)])


def tag_dataset(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("dataset", F.lit(name))


def expand_struct(df: DataFrame, column: str) -> DataFrame:
    """Fields of a struct column as columns next to the others."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")


def assert_unique_columns(*frames: DataFrame) -> None:
    for df in frames:
        twice = sorted({c for c in df.columns if df.columns.count(c) > 1})
        if twice:
            raise ValueError(f"duplicate columns: {twice}")


def assert_has_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"column {name!r} is missing")


def union_frames(*frames: DataFrame) -> DataFrame:
    """Stack by column name; a column one side lacks is null there."""
    assert_unique_columns(*frames)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_tagged(frames: dict[str, DataFrame]) -> DataFrame:
    """Stack frames, each with its name in ``dataset``."""
    return union_frames(*[tag_dataset(df, name) for name, df in frames.items()])


def recent_notes(
    df: DataFrame,
    marker: str,
    as_of: Column,
    months: int = 2,
    note: str = "agent_notes",
    created: str = "created_at",
) -> DataFrame:
    """Notes that hold ``marker``, not older than ``months`` before ``as_of``."""
    return df.filter(F.col(note).contains(marker) & within_months(F.col(created), as_of, months))


def within_months(created: Column, as_of: Column, months: int) -> Column:
    return created >= as_of - F.make_ym_interval(F.lit(0), F.lit(months))


def parse_dates(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: X.parse_time(c) for c in columns})


def row_count(df: DataFrame) -> DataFrame:
    """Rows and columns of a frame as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
