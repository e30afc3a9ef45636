"""Near copies by SimHash: segment bit counts, a grid join on them, exact check, components."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.common import columns_of, components, heavy_join, over_batches, store, whole_row

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Segments are two bits wide: 32 counts of 0, 1 or 2 describe a fingerprint.
SEGMENTS = 32
#: Points that share a cell with a point by chance, at most, on average; decides into how many blocks segments are cut.
BY_CHANCE = 8
MOST_BLOCKS = 12
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased word shingles, as an unsigned number; 0 without words."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, last, _CHUNK):
        stop = min(last, start + _CHUNK)
        h = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(start, stop)]
        octets = np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of each row; null and empty texts have fingerprint 0."""
    plain = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("_bytes"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, shingle) for t in batch.column("_bytes").to_pylist()]
        signed = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), signed], [id_col, "fp"])

    return over_batches(plain, run, f"`{id_col}` {plain.schema[id_col].dataType.simpleString()}, fp bigint")


def segment_counts(fp: Column) -> Column:
    """The bit count of each two-bit segment, in unary: 0 is 00, 1 is 01, 2 is 11.

    In this code the Manhattan distance of two count vectors is the number of
    differing bits, and it never exceeds the distance of the fingerprints.
    """
    odd = F.lit(0x5555555555555555).cast("bigint")
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(odd)
    both = fp.bitwiseAND(high).bitwiseAND(odd)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int) -> list[int]:
    """The bits of each block of neighbouring segments."""
    edges = [2 * (SEGMENTS * i // blocks) for i in range(blocks + 1)]
    return [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]


def block_count(points: int, max_bits: int = MAX_BITS) -> int:
    """Blocks for a number of points: the fewest at which random points share few cells.

    More blocks make finer cells, of more kinds.  Two random segments have equal
    counts with a chance of 3/8.
    """
    for blocks in range(max_bits + 2, MOST_BLOCKS):
        segments = SEGMENTS * (blocks - max_bits) / blocks
        if points * comb(blocks, max_bits) * 0.375**segments / 2 <= BY_CHANCE:
            return blocks
    return max(MOST_BLOCKS, max_bits + 2)


def linked_fingerprints(reps: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of distinct ``fp`` that differ in at most ``max_bits`` bits.

    Of ``blocks`` blocks a Manhattan distance of ``max_bits`` leaves at least
    ``blocks - max_bits`` unchanged: two points in range share the grid cell of
    some choice of so many blocks.  Equal cells meet in a join, cut by the
    Manhattan distance of the counts (the lower bound) and then by the exact
    distance.  A pair is given for the first choice of blocks that both share,
    so once.
    """
    blocks = block_count(reps.count(), max_bits) if blocks is None else blocks
    if blocks <= max_bits:
        raise ValueError("more blocks than differing bits are needed")
    masks = block_masks(blocks)
    kinds = []
    for chosen in combinations(range(blocks), blocks - max_bits):
        cell = F.col("counts").bitwiseAND(F.lit(_signed(sum(masks[i] for i in chosen))))
        kind, upto = sum(1 << i for i in chosen), (1 << (chosen[-1] + 1)) - 1
        kinds.append(F.struct(F.lit(kind).alias("kind"), F.lit(upto).alias("upto"), cell.alias("cell")))
    points = reps.select("fp", segment_counts(F.col("fp")).alias("counts")).select("fp", "counts", F.explode(F.array(*kinds)).alias("at"))
    points = points.select("fp", "counts", "at.*")
    a, b = points.alias("a"), points.alias("b")
    apart = F.col("a.counts").bitwiseXOR(F.col("b.counts"))
    same = sum((F.when(apart.bitwiseAND(F.lit(_signed(m))) == 0, 1 << i).otherwise(0) for i, m in enumerate(masks)), F.lit(0))
    near = (
        (F.col("a.kind") == F.col("b.kind"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(apart) <= max_bits)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
        # no earlier choice: up to the last block of this one no other block is the same
        & (same.bitwiseAND(F.col("a.upto")) == F.col("a.kind"))
    )
    # each point is here once per kind, up to hundreds of times, which Spark's estimate leaves out: it would broadcast them
    return a.join(b.hint("merge"), near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def group_fingerprints(fps: DataFrame, id_col: str, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, n_rows, component_id) of each distinct fingerprint of a stored (id, fp) table.

    All tables grow with the documents, whatever their files' size: none is broadcast,
    but for the rows of at most 1000 roots with very many nodes.
    """
    reps = store(fps.groupBy("fp").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("n_rows")), "simhash-reps")
    links = linked_fingerprints(reps, max_bits)
    roots = store(components(links, "a", "b"), "simhash-roots")
    members = reps.join(roots.hint("merge"), F.col("fp") == F.col("node"))
    least = store(members.groupBy("root").agg(F.min("_first").alias("_least"), F.count(F.lit(1)).alias("_n")), "simhash-least")
    linked = heavy_join(roots, least, "root", "_n", roots.count()).select(F.col("node").alias("fp"), "_least")
    return reps.join(linked.hint("merge"), "fp", "left").select("fp", "n_rows", F.coalesce("_least", "_first").alias("component_id"))


def near_copies(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id reachable by links.

    Rows with equal fingerprints are one point; points link at ``max_bits`` or
    fewer differing bits.  Null, empty and white-space texts have fingerprint 0
    and link like any other.  A null id is grouped but never names a component
    unless all its ids are null.  Repeated rows come back as often as given.
    """
    fps = store(fingerprints(df, id_col, text_col, shingle), "simhash")
    groups = store(group_fingerprints(fps, id_col, max_bits), "simhash-groups")
    return heavy_join(fps, groups, "fp", "n_rows", fps.count())


def drop_near_copies(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` without near copies: one row of each component stays.

    The one with the smallest id, then with the smallest hash of the row; null
    ids come last.  Of wholly equal rows one stays.
    """
    names = df.columns
    row = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    marked = df.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), row.alias("hash")).alias("_key"), F.col(text_col).alias("_text"))
    fps = store(fingerprints(marked, "_key", "_text", shingle), "simhash")
    groups = group_fingerprints(fps, "_key", max_bits)
    counts = fps.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).hint("merge")
    stay = store(groups.select(F.col("component_id").alias("_key")).distinct().join(counts, "_key"), "simhash-stay")
    keyed = df.select(whole_row(df).alias("row"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), row.alias("hash")).alias("_key"))
    keyed = keyed.withColumn("at", F.xxhash64("_key"))
    # the keys grow with the documents: joined by a shuffle at every size, never broadcast
    wanted = stay.select(F.xxhash64("_key").alias("at"), F.col("_key").alias("_stays"), "_n").hint("merge")
    same_key = (keyed["at"] == wanted["at"]) & keyed["_key"].eqNullSafe(wanted["_stays"])
    once = keyed.join(wanted.filter("_n = 1"), same_key, "left_semi")
    again = keyed.join(wanted.filter("_n > 1"), same_key, "left_semi").dropDuplicates(["_key"])
    return once.unionByName(again).select(*columns_of("row", names))
