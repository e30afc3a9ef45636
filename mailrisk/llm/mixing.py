"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailrisk.llm.common import columns_of, store, whole_row

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Expected copies are whole multiples of 2^-24, so prefix sums are exact in any order.
UNIT = 1 << 24
#: Random starts drawn for a source; the one that comes nearest to its target is taken.
STARTS = 64
#: Lanes per million rows; a source's rows of one size class are dealt to the lanes.
LANES = 16

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``target`` to a table with one row per source (``source``, ``source_size``), small for any corpus.

    Sources weigh ``weights`` in turn, by code point, null last.  The target of
    a source is its weight times a common level, or ``most`` times its size if
    that is less; the level is where the targets add up to ``share`` of all
    sizes, which is where sharing the excess again and again ends.  With sources
    in the order of the level at which they are full, it is the most that is
    left per weight after any number of them is full.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("_weight", weight.cast("bigint"))
    cap = F.col("source_size") * most
    by_level = Window.orderBy(cap / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    full = F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    total = F.sum("source_size").over(everything)
    level = (total * F.lit(float(share)) - full) / weight_left
    leveled = weighed.withColumn("_level", level)
    target = F.least(cap.cast("double"), F.col("_weight") * F.max("_level").over(everything))
    return leveled.withColumn("target", target).drop("_weight", "_level")


def _hashed(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def _best_starts(lots: DataFrame, seed: str) -> DataFrame:
    """(_named, _source, _start) from the lots of each source: few rows, however many documents."""
    name = F.when(F.col("_named"), F.concat(F.lit("="), "_source")).otherwise("")
    draws = lots.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    draws = draws.withColumn("_start", _hashed(F.concat_ws("|", F.lit(seed), F.col("_draw").cast("string"), name), 6))
    first = F.col("_before") + F.col("_start")
    copies = F.shiftright(first + F.col("_n") * F.col("_rate"), 24) - F.shiftright(first, 24)
    # mean sizes in sixteenths of a word: whole numbers add up the same in any order
    words = F.sum(copies * F.expr("(_words * 16) div _n")).alias("_taken")
    sums = draws.groupBy("_named", "_source", "_draw", "_start", "target").agg(words)
    off = F.struct(F.abs(F.col("_taken") - F.col("target") * 16), F.col("_draw"))
    return sums.groupBy("_named", "_source").agg(F.min_by("_start", off).alias("_start"))


def plan_copies(
    df: DataFrame, id_col: str, source_col: str, size_col: str,
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``df`` with ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size).

    Within a source the expected copies of its documents are summed in the
    order of size class, lane, size and id; a random start, fixed by the seed
    and the source, is added; each whole number crossed is one copy.  Order by
    size keeps the words taken close to the target.  In a small source its few
    longest documents decide how close, so of ``STARTS`` random starts the one
    is taken whose copies of each lot, at the mean size of the lot, come nearest
    to the target.  A source's rows are spread
    over lanes, whose number grows with the table, and only lane totals are
    summed across; so no source, however large, is one task.  Equal rows are
    separate documents, and the same ones are taken in each run.  Null sizes count
    as 0, and null ids as one id.  Columns
    of ``df`` named like an added one are replaced.  ``sizes`` are the three
    columns of ``df`` alone, if they are at hand as a table: the sums are read
    from it, and ``df`` only once.
    """
    sizes = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys((id_col, source_col, size_col))]) if sizes is None else sizes
    lanes = LANES * max(1, -(-sizes.count() // 1_000_000))
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")
    lane = F.pmod(_hashed(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 8), F.lit(lanes))
    at = [
        F.col(source_col).isNotNull().alias("_named"),
        F.coalesce(F.col(source_col), F.lit("")).alias("_source"),
        size.alias("_size"),
        F.floor(F.sqrt(size)).cast("bigint").alias("_class"),
        lane.alias("_lane"),
    ]
    keyed = df.select(whole_row(df).alias("row"), F.col(id_col).alias("_id"), *at)
    place = ["_named", "_source", "_class", "_lane"]
    totals = sizes.select(*at).groupBy(*place).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words"))
    totals = store(totals, "mix-lots")
    per_source = totals.groupBy("_named", "_source").agg(F.sum("_words").alias("source_size"))
    named = per_source.withColumn("source", F.when(F.col("_named"), F.col("_source")))
    wanted = targets(named, weights, share, most).select("_named", "_source", "source_size", "target")
    rate = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0)) * UNIT), F.lit(0)).cast("bigint")
    # two levels: size classes of a source, of which there are few, and the lanes of a class
    before = (Window.unboundedPreceding, -1)
    classes = totals.groupBy("_named", "_source", "_class").agg(F.sum("_n").alias("_upto"))
    smaller = Window.partitionBy("_named", "_source").orderBy("_class").rowsBetween(*before)
    classes = classes.withColumn("_upto", F.coalesce(F.sum("_upto").over(smaller), F.lit(0)))
    lanes_before = Window.partitionBy("_named", "_source", "_class").orderBy("_lane").rowsBetween(*before)
    lots = totals.withColumn("_inside", F.coalesce(F.sum("_n").over(lanes_before), F.lit(0)))
    lots = lots.join(classes, ["_named", "_source", "_class"]).join(wanted, ["_named", "_source"]).withColumn("_rate", rate)
    lots = lots.withColumn("_before", (F.col("_upto") + F.col("_inside")) * F.col("_rate")).drop("_upto", "_inside")
    lots = lots.join(_best_starts(lots, seed), ["_named", "_source"])
    lots = lots.withColumn("_before", F.col("_before") + F.col("_start")).drop("_n", "_words", "_start")
    # rows of equal size and id are told apart by what else they hold
    through = Window.partitionBy(*place).orderBy("_size", "_id", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("_rate").over(through)
    crossed = F.shiftright(upto, 24) - F.shiftright(upto - F.col("_rate"), 24)
    chosen = keyed.join(lots, place).withColumn("copies", crossed.cast("bigint"))
    chosen = chosen.withColumn("taken", F.col("copies") * F.col("_size"))
    added = ["source_size", "target", "copies", "taken"]
    return chosen.select(*columns_of("row", [c for c in df.columns if c not in added]), *added)


def mix(df: DataFrame, id_col: str, source_col: str, text_col: str, **how) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    named = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")]
    sizes = store(df.select(*named), "mix-sizes")
    planned = plan_copies(df.select(whole_row(df).alias("doc"), *named), "id", "source", "size", sizes=sizes, **how).filter("copies > 0")
    each = planned.select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return each.select(*columns_of("doc", df.columns))


#: The same rows in SQL, for any number of lanes.
ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight
  FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * {SHARE}
           - coalesce(sum(source_size * {MOST}) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY source_size * {MOST} / weight::DOUBLE, source NULLS LAST)),
t AS (
  SELECT source, source_size,
         least((source_size * {MOST})::DOUBLE, weight * max(level) OVER ()) AS target
  FROM l),
r AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size * {UNIT}) END::BIGINT AS rate,
         CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS name
  FROM t),
placed AS (
  SELECT *, floor(sqrt(size))::BIGINT AS class,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
           % (SELECT {LANES} * greatest(1, (count(*) + 999999) // 1000000) FROM documents) AS lane
  FROM sized),
lots AS (SELECT source, class, lane, count(*) AS n, sum(size)::BIGINT AS words FROM placed GROUP BY ALL),
summed AS (
  SELECT r.name, r.target, r.rate, n, words,
         (coalesce(sum(n) OVER (PARTITION BY r.name ORDER BY class, lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * r.rate)::BIGINT AS before
  FROM lots JOIN r ON lots.source IS NOT DISTINCT FROM r.source),
drawn AS (
  SELECT *, ('0x' || substr(md5('{SEED}|' || draw || '|' || name), 1, 6))::BIGINT AS start
  FROM summed CROSS JOIN range({STARTS}) d(draw)),
tried AS (
  SELECT name, draw, start, target,
         sum((((before + start + n * rate) >> 24) - ((before + start) >> 24)) * (words * 16 // n))::BIGINT AS taken
  FROM drawn GROUP BY ALL),
chosen AS (SELECT name, start FROM tried QUALIFY row_number() OVER (PARTITION BY name ORDER BY abs(taken::DOUBLE - target * 16), draw) = 1),
p AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.rate,
         c.start + r.rate * row_number() OVER (PARTITION BY d.source ORDER BY class, lane, d.size, d.doc_id NULLS FIRST) AS upto
  FROM placed d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN chosen c USING (name))
SELECT doc_id, size, source_size, target, ((upto >> 24) - ((upto - rate) >> 24)) * size AS taken FROM p
"""
