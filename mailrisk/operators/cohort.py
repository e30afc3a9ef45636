"""Who sent how much, who was suspended, and what was sent shortly before."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailrisk.functions import text as X
from mailrisk.operators.joins import BROADCAST_ROWS, lookup_join
from mailrisk.operators.ranking import latest_per_user
from mailrisk.operators.rows import within_months
from mailrisk.session import stored


def active_users(
    log: DataFrame, as_of: Column, months: int = 2, user: str = "user_id", created: str = "created"
) -> DataFrame:
    """Mails per user in the last ``months``."""
    recent = log.filter(within_months(F.col(created), as_of, months))
    return recent.groupBy(user).agg(F.count(F.lit(1)).alias("email_count"))


def active_users_over(counts: DataFrame, n: int) -> DataFrame:
    return counts.filter(F.col("email_count") > n)


def emails_per_user(mails: DataFrame, user: str = "user_id") -> DataFrame:
    return mails.groupBy(user).agg(F.count(F.lit(1)).alias("email_count"))


def user_email_stats(
    users: DataFrame, mails: DataFrame, user: str = "user_id"
) -> DataFrame:
    """Mails of every listed user, 0 for users without any.

    Mails are counted before the join: a user with very many is one row by then.
    """
    counts = emails_per_user(mails, user)
    joined = users.select(user).distinct().join(counts, user, "left")
    return joined.select(
        F.col(user).alias("user"), F.coalesce("email_count", F.lit(0)).alias("email_count")
    )


def suspended_users(notes: DataFrame) -> DataFrame:
    """Latest suspension of each user."""
    return latest_per_user(notes.select("user_id", "created_at"))


def join_suspensions(
    mails: DataFrame,
    suspended: DataFrame,
    spread: str = "msg_id",
    rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Mails of suspended users with the time of suspension."""
    return lookup_join(mails, suspended, "user_id", spread=spread, how="inner", rows=rows)


def suspension_window(
    mails: DataFrame,
    suspended: DataFrame,
    days: int = 3,
    upper: bool = False,
    spread: str = "msg_id",
    email_date: str = "email_date",
    rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Mails sent after ``days`` days before suspension; ``upper`` ends at the suspension.

    The lower bound is strict, the upper one inclusive, as the cohort is
    defined.  The days that can matter at all are found first, in one row, so
    the scan of the mails skips the history before and, with ``upper``, after.
    """
    sent = F.col(email_date)
    # a row per suspended user, read three times: its ends, its size and the join
    suspended = stored(suspended, "suspended")
    first, last = suspended.agg(F.min("created_at"), F.max("created_at")).first()
    if first is None:
        return join_suspensions(mails.limit(0), suspended, spread, rows)

    def at(time: datetime) -> Column:
        # a time without zone is written out: as a literal it would take one
        zoned = isinstance(suspended.schema["created_at"].dataType, T.TimestampType)
        return F.lit(time) if zoned else F.lit(time.isoformat(sep=" ")).cast("timestamp_ntz")

    # an hour more than needed: a day can have 25 of them
    mails = mails.filter(sent > at(first - timedelta(days=days, hours=1)))
    if upper:
        mails = mails.filter(sent <= at(last + timedelta(hours=1)))
    joined = join_suspensions(mails, suspended, spread, rows)
    start = F.col("created_at") - F.make_dt_interval(F.lit(days))
    inside = sent > start
    if upper:
        inside = inside & (sent <= F.col("created_at"))
    return joined.filter(inside)


def attach_file_links(
    mails: DataFrame, links: DataFrame, msg_id: str = "msg_id", rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Add ``filename`` and the sheet formula of its stored HTML file."""
    named = mails.withColumn("filename", X.html_key(msg_id))
    joined = lookup_join(named, links, "filename", spread=msg_id, rows=rows)
    return joined.withColumn("HTML_File_Link", X.hyperlink("file_id")).drop("file_id")


def count_unmapped(mails: DataFrame, links: DataFrame, msg_id: str = "msg_id") -> DataFrame:
    """How many rows have no entry in the link table (equal rows all count).

    The link table can be as large as the mails: it is joined by a shuffle, whatever the size of its files.
    """
    named = mails.select(X.html_key(msg_id).alias("filename"))
    per_file = named.groupBy("filename").agg(F.count(F.lit(1)).alias("n"))
    missing = per_file.join(links.select("filename").hint("merge"), "filename", "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unmapped"))


def pending_only(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Each key once, without those already done."""
    return todo.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")
