"""Counts, shares and histograms of labels and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.operators.joins import fits_broadcast
from mailrisk.session import stored

BINS = 50
THRESHOLD = 0.99


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value, most frequent first; null is no value."""
    counts = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *columns)


def value_counts_above(
    df: DataFrame, *columns: str, score: str = "score", threshold: float = THRESHOLD
) -> DataFrame:
    return value_counts(df.filter(F.col(score) >= threshold), *columns)


def long_scores(df: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """Wide ``<model>_label``, ``<model>_score`` columns to rows (keys, model, label, score)."""
    rows = [
        F.struct(
            F.lit(m).alias("model"),
            F.col(f"{m}_label").cast("int").alias("label"),
            F.col(f"{m}_score").cast("double").alias("score"),
        )
        for m in models
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


def flag_share(long: DataFrame, by: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Percent of rows labelled 1 with a score of at least ``threshold``."""
    flagged = (F.col("label") == 1) & (F.col("score") >= threshold)
    return long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(flagged).alias("n_flagged"),
        (F.lit(100.0) * F.count_if(flagged) / F.count(F.lit(1))).alias("share"),
    )


def score_histogram(
    df: DataFrame,
    by: list[str],
    score: str = "score",
    bins: int = BINS,
    threshold: float | None = None,
) -> DataFrame:
    """Equal-width bins between the smallest and largest score of each group.

    Empty bins count 0; the last bin holds its upper edge; a group of one value
    gets edges half a unit to either side; a null group is a group.  Two passes
    over ``df``: one for the edges, one that bins each row and counts, so at
    most ``bins`` rows per group and task are shuffled.  Hand in a stored table
    where scores are costly to compute.
    """
    rows = df.filter(F.col(score).isNotNull())
    if threshold is not None:
        rows = rows.filter(F.col(score) >= threshold)
    edges = rows.groupBy(*by).agg(F.min(score).alias("_min"), F.max(score).alias("_max"))
    flat = F.col("_min") == F.col("_max")
    edges = edges.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi"),
    )
    edges = stored(edges, "edges")  # a row per group, read by the size test and by the join
    if fits_broadcast(edges):
        edges = F.broadcast(edges)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    spot = F.floor((F.col(score) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo")))
    spot = F.least(spot, F.lit(bins - 1)) + 1
    group = [*by, "_lo", "_hi"]
    counted = rows.select(*by, score).join(edges, same).groupBy(*group, spot.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    filled = counted.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_counts"))
    numbers = F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return filled.withColumn("bin", F.explode(numbers)).select(
        *by,
        "bin",
        (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_start"),
        F.coalesce(F.col("_counts")[F.col("bin")], F.lit(0)).alias("n"),
    )


def model_report(
    long: DataFrame, by: list[str], threshold: float = THRESHOLD
) -> DataFrame:
    """Every label figure of every group in one aggregation of one scan."""
    label, score = F.col("label"), F.col("score")
    above = score >= threshold
    return long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(label == 1).alias("n_phish"),
        F.count_if(label == 0).alias("n_legit"),
        F.count_if(above & (label == 1)).alias("n_phish_above"),
        F.count_if(above & (label == 0)).alias("n_legit_above"),
        (F.lit(100.0) * F.count_if(above & (label == 1)) / F.count(F.lit(1))).alias("share"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"),
    )
