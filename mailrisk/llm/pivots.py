"""Near copies among vectors by a pivot-permutation index, then exact cosine and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.common import bounded_sample, components, heavy_join, store
from mailrisk.llm.hnsw import usable
from mailrisk.operators.joins import lookup_join

#: Reference points for the vectors of each length, at most.
PIVOTS = 256
#: They are picked, spread out, from a sample of so many distinct vectors.
SAMPLE = 2048
#: Nearest reference points that describe a vector.
NEAREST = 10
#: Reference points two vectors must share to be compared.
SHARED = 4
MIN_COSINE = 0.93
#: Members of an inverted list that are held together; longer lists are cut into blocks that meet in pairs.
BLOCK = 512


def _describe(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add ``near``: the numbers of the NEAREST pivots, nearest first."""
    schema = rows.schema
    at = rows.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            values, ends = column.flatten().to_numpy(), column.value_lengths().to_numpy()
            near: list = [None] * len(ends)
            starts = np.cumsum(ends) - ends
            for dim in np.unique(ends):
                which = np.flatnonzero(ends == dim)
                if int(dim) not in pivots:
                    for i in which:
                        near[i] = [0]
                    continue
                vectors = values[starts[which][:, None] + np.arange(dim)]
                cosine = vectors @ pivots[int(dim)].T  # the pivots are unit vectors; a row's own length does not matter
                best = np.argsort(-cosine, axis=1, kind="stable")[:, :NEAREST]
                for i, b in zip(which, best):
                    near[i] = b.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], [*batch.schema.names, "near"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return rows.mapInArrow(run, f"{fields}, near array<int>")


def spread_out(units: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of the unit vectors, in the given order, no two of them close.

    A dense group would otherwise hold many reference points, and its members
    would differ in which of them are nearest.  How close is too close is
    relaxed until there are enough, never beyond what may be a near copy.
    """
    for closest in (0.5, 0.6, 0.7, 0.8):
        kept: list[int] = []
        near = np.zeros(len(units), dtype=bool)
        for i in range(len(units)):
            if not near[i]:
                kept.append(i)
                near |= units @ units[i] >= closest
                if len(kept) == count:
                    return units[kept]
    return units[kept]


def choose_pivots(rows: DataFrame, count: int = PIVOTS) -> dict[int, np.ndarray]:
    """Unit reference points by vector length, from a bounded sample, by a hash, of the vectors of each.

    Beyond the ``_LENGTHS`` most frequent lengths there are none: vectors of such a
    length are one list, which is compared whole, in pairs of blocks.
    """
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(_LENGTHS)
    dims = [r["dim"] for r in lengths.collect()]
    pivots = {}
    for dim in sorted(dims):
        picked = bounded_sample(rows.filter(F.size("vector") == dim).select("rep", "vector"), "rep", SAMPLE).collect()
        found = np.array([r["vector"] for r in picked], dtype=np.float64)
        pivots[dim] = spread_out(found / np.linalg.norm(found, axis=1, keepdims=True), count)
    return pivots


_LENGTHS = 64
_ONE_PLACE = np.zeros(1, dtype=np.int64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component under the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(reps: np.ndarray, blocks: np.ndarray, counts: np.ndarray, vectors: np.ndarray, near: np.ndarray, pivot: int, places: np.ndarray, shared: int, least: float):
    """Links within an inverted list, or between two blocks of it.

    Yields (rep, rows linked, root): linked rows per member, and the smallest
    member it reaches here.  A pair that also shares an earlier list is left to
    that one, so each is counted once.
    """
    n = len(reps)
    first, second = blocks.min(), blocks.max()
    own, other = np.flatnonzero(blocks == first), np.flatnonzero(blocks == second)
    width = places.size
    marks = np.zeros((n, width), dtype=np.float32)
    np.put_along_axis(marks, near.astype(np.int64), 1, axis=1)
    indexed = np.zeros((n, width), dtype=np.float32)
    np.put_along_axis(indexed, _indexed(near, places, shared).astype(np.int64), 1, axis=1)
    earlier = indexed * (places < places[pivot])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    enough = marks[own] @ marks[other].T >= shared
    enough &= earlier[own] @ earlier[other].T == 0
    i, j = np.nonzero(enough)
    if first == second:
        keep = i < j
        i, j = i[keep], j[keep]
    i, j = own[i], other[j]
    close = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), _PAIRS):
        part = slice(at, at + _PAIRS)
        close[part] = np.einsum("ij,ij->i", unit[i[part]], unit[j[part]]) >= least
    i, j = i[close], j[close]
    links = np.bincount(i, counts[j], n) + np.bincount(j, counts[i], n)
    root = _roots(n, i, j)
    linked = np.flatnonzero(links)
    return reps[linked], links[linked].astype(np.int64), reps[root[linked]]


_PAIRS = 1 << 16


def _indexed(near: np.ndarray, places: np.ndarray, shared: int) -> np.ndarray:
    """The pivots under which a vector is listed: its rarest ones.

    Two vectors that share ``shared`` of their pivots have one of the first
    NEAREST - ``shared`` + 1 in common, in any order common to all.
    """
    order = np.argsort(places[near], axis=1, kind="stable")
    return np.take_along_axis(near, order, 1)[:, : near.shape[1] - shared + 1]


def link_classes(classes: DataFrame, least: float = MIN_COSINE, shared: int = SHARED) -> DataFrame:
    """(rep, n_linked, root) partial rows over inverted lists of a stored class table.

    Sum ``n_linked`` by rep; (rep, root) are edges.  Only members of one list
    are compared, list by list or pair of blocks by pair of blocks, so a task
    holds two blocks and pairs are never written out.
    """
    pivots = choose_pivots(classes)
    described = store(_describe(classes, pivots), "pivot-near")
    counted = described.filter(F.size("vector").isin(list(pivots)))
    use = counted.select(F.size("vector").alias("dim"), F.explode("near").alias("pivot")).groupBy("dim", "pivot").count().collect()
    places: dict[int, np.ndarray] = {}  # rank of each pivot by how rare it is; at most PIVOTS a length
    for dim, points in pivots.items():
        frequency = np.zeros(len(points), dtype=np.int64)
        for r in use:
            if r["dim"] == dim:
                frequency[r["pivot"]] = r["count"]
        places[dim] = np.argsort(np.argsort(frequency, kind="stable"), kind="stable")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, dims = batch.column("near"), batch.column("vector").value_lengths().to_numpy()
            out: list = [None] * len(dims)
            for dim in np.unique(dims):
                which = np.flatnonzero(dims == dim)
                rows = near.take(pa.array(which)).flatten().to_numpy().reshape(len(which), -1)
                for i, chosen in zip(which, _indexed(rows, places.get(int(dim), _ONE_PLACE), min(shared, rows.shape[1])).tolist()):
                    out[i] = chosen
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "lists"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in described.schema.fields)
    entries = described.mapInArrow(listed, f"{fields}, lists array<int>").withColumn("dim", F.size("vector"))
    entries = entries.select("label", "dim", F.explode("lists").alias("pivot"), "rep", "n_rows", "vector", "near")
    members = entries.groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("members"))
    long = store(members.filter(F.col("members") > BLOCK), "pivot-lists")
    long = long.select("label", "dim", "pivot", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    # broadcast if its size allows, else by (list, salt): a long list is many tasks either way
    placed = lookup_join(entries, long, ["label", "dim", "pivot"], spread="rep")
    blocks = F.coalesce("blocks", F.lit(1))
    block = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("block", block)
    placed = placed.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "label", "dim", "pivot", F.least("block", "mate").alias("low"), F.greatest("block", "mate").alias("high"),
        "block", "rep", "n_rows", "vector", "near",
    )
    key = ["label", "dim", "pivot", "low", "high"]
    dealt = placed.repartition(*key).sortWithinPartitions(*key, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            rows = group.column("near").combine_chunks()
            dim, pivot = group.column("dim")[0].as_py(), group.column("pivot")[0].as_py()
            n = group.num_rows
            near = rows.flatten().to_numpy().reshape(n, -1)
            vectors = group.column("vector").combine_chunks().flatten().to_numpy().reshape(n, dim)
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            blocks = group.column("block").to_numpy()
            if low != high and blocks.min() == blocks.max():
                continue
            found = _compare(
                group.column("rep").to_numpy(), blocks, group.column("n_rows").to_numpy(), vectors, near,
                pivot, places.get(dim, _ONE_PLACE), min(shared, near.shape[1]), least,
            )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["rep", "n_linked", "root"])

    return dealt.mapInArrow(run, "rep bigint, n_linked bigint, root bigint")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of equal (label, dim, pivot, low, high) in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if a == b:
                continue
            key = tuple(keys[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def near_copies(df: DataFrame, id_col: str, vector_col: str, label_col: str, least: float = MIN_COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows of one label link when their cosine is at least ``least`` and they
    share SHARED of their NEAREST pivots.  Rows with equal label and vector are
    one class and are compared once: each links with all the others of its
    class.  Rows without label, and unusable vectors (null, zero, with null or
    non-finite components), link with nothing; so do vectors of other lengths.
    ``component_id`` is the smallest id reachable; a null id is counted as a
    row but names no component unless all its ids are null.
    """
    ok = F.col(label_col).isNotNull() & usable(F.col(vector_col))
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.when(ok, F.col(label_col)).cast("bigint").alias("label"), F.when(ok, vector).alias("vector"))
    rows = store(rows.withColumn("rep_hash", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector"))), "pivot-rows")
    alive = rows.filter("vector is not null")
    # equal vectors of a label: the hash names the class, the vector itself confirms it
    classes = alive.groupBy("label", "vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_rows"), F.min("rep_hash").alias("rep"))
    classes = store(classes.select("label", "vector", "first", "n_rows", "rep"), "pivot-classes")
    partial = store(link_classes(classes.select("label", "rep", "n_rows", "vector"), least), "pivot-links")
    linked = partial.groupBy("rep").agg(F.sum("n_linked").alias("n_linked"))
    roots = store(components(partial, "rep", "root"), "pivot-roots")
    least_id = classes.join(roots, F.col("rep") == F.col("node")).groupBy("root").agg(F.min("first").alias("least"))
    named = roots.join(least_id, "root").select(F.col("node").alias("rep"), "least")
    result = classes.join(linked, "rep", "left").join(named, "rep", "left")
    result = result.select(
        F.col("rep").alias("rep_hash"), "n_rows",
        (F.coalesce("n_linked", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"),
    )
    result = store(result, "pivot-result")
    single = rows.filter("vector is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    some = alive.select("id", "rep_hash")
    every = heavy_join(some, result, "rep_hash", "n_rows", some.count()).select("id", "n_links", "component_id")
    every = every.unionByName(single)
    return every.select("id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
