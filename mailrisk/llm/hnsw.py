"""Nearest neighbours: a navigable small-world graph per shard, shard results merged.

A shard's graph is layered: every layer keeps about one in ``LAYER`` points of
the one below, and each point has a row of a flat neighbour array per layer.
All queries of a batch walk the graph together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailrisk.llm.common import store

#: Rows of a shard, on average: its vectors and graph are what a task holds.
SHARD_ROWS = 8192
#: Neighbours of a point on a layer, at most; twice as many on the lowest.
NEIGHBOURS = 16
#: Points of a layer that the next one keeps: one in so many.
LAYER = 16
#: Candidates a point's neighbours are chosen from.
CANDIDATES = 48
#: Width of the search on the lowest layer.
BEAM = 192
TOP = 10
SEED = 5
_BLOCK = 512


def usable(vector: Column) -> Column:
    """Whether a vector is there, without null or non-finite components, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(-1)[:, None] + (b * b).sum(-1)[None, :] - 2 * a @ b.T, 0)


def _choose(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, limit: int) -> np.ndarray:
    """Neighbours of each point of ``own`` among its candidates, nearest first.

    A candidate that is nearer to a chosen neighbour than to the point is
    passed over; places left at the end go to the nearest of those.
    """
    n, width = candidates.shape
    near = points[candidates]
    there = np.where(candidates == own[:, None], np.inf, ((near - points[own][:, None]) ** 2).sum(-1))
    order = np.argsort(there, axis=1, kind="stable")
    candidates, there = np.take_along_axis(candidates, order, 1), np.take_along_axis(there, order, 1)
    near = np.take_along_axis(near, order[:, :, None], 1)
    norm = (near * near).sum(-1)
    between = norm[:, :, None] + norm[:, None, :] - 2 * near @ near.transpose(0, 2, 1)
    chosen = np.zeros((n, width), dtype=bool)
    for k in range(width):
        shadowed = (chosen & (between[:, k] < there[:, k, None])).any(axis=1)
        chosen[:, k] = ~shadowed & np.isfinite(there[:, k]) & (chosen.sum(axis=1) < limit)
    first = np.argsort(np.where(chosen, 0, 1) + np.where(np.isfinite(there), 0, 2), axis=1, kind="stable")[:, :limit]
    picked = np.take_along_axis(candidates, first, 1)
    return np.where(np.isfinite(np.take_along_axis(there, first, 1)), picked, -1).astype(np.int32)


def _layer(points: np.ndarray, members: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """Neighbour array of a layer: chosen among near and a few far members, then made mutual."""
    n = len(members)
    rows = np.full((len(points), limit), -1, dtype=np.int32)
    if n < 2:
        return rows
    own = points[members]
    width = min(n, CANDIDATES)
    half = np.full((n, limit), -1, dtype=np.int32)
    for at in range(0, n, _BLOCK):
        d = _square_distances(own[at : at + _BLOCK], own)
        near = np.argpartition(d, width - 1, axis=1)[:, :width] if width < n else np.tile(np.arange(n), (len(d), 1))
        far = rng.integers(0, n, (len(d), 8))  # links out of tight groups
        picked = _choose(own, np.arange(at, at + len(d)), np.concatenate([near, far], axis=1), limit // 2)
        half[at : at + len(d), : picked.shape[1]] = picked
        half[at : at + len(d), limit // 2] = far[:, 0]
    # every link also backwards, while the other end has room
    ends = np.argwhere(half >= 0)
    source, target = ends[:, 0], half[ends[:, 0], ends[:, 1]].astype(np.int64)
    filled = (half >= 0).sum(axis=1)
    packed = np.take_along_axis(half, np.argsort(half < 0, axis=1, kind="stable"), 1)
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    place = filled[target] + rank
    room = place < limit
    packed[target[room], place[room]] = source[room]
    packed = np.sort(packed, axis=1)[:, ::-1].copy()
    packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = -1  # each link once
    rows[members] = np.where(packed >= 0, members[np.maximum(packed, 0)], -1)
    return rows


@dataclass
class Graph:
    """Distinct points, the rows that have each, and one neighbour array per layer."""

    points: np.ndarray  # float64, one row per distinct vector
    owners: list[np.ndarray]  # ids of the rows with a vector, ascending
    layers: list[np.ndarray]  # lowest first
    entry: int


def build(ids: np.ndarray, vectors: np.ndarray, seed: int = SEED) -> Graph:
    """The graph of a shard.  Equal vectors are one point, so copies cannot crowd its links."""
    points, which = np.unique(vectors, axis=0, return_inverse=True)
    which = which.reshape(-1)
    order = np.lexsort((ids, which))
    owners = np.split(ids[order], np.cumsum(np.bincount(which, minlength=len(points)))[:-1])
    rng = np.random.default_rng(seed)
    height = np.floor(-np.log(rng.random(len(points))) / np.log(LAYER)).astype(int)
    layers, members = [], np.arange(len(points))
    level = 0
    while level == 0 or len(members) > 1:
        layers.append(_layer(points, members, NEIGHBOURS * (2 if level == 0 else 1), rng))
        level += 1
        entry = int(members[0])
        members = np.flatnonzero(height >= level)
    return Graph(points, owners, layers, int(members[0]) if len(members) else entry)


def _walk(graph: Graph, layer: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of a layer from one point per query: (points, square distances), nearest first."""
    n = len(queries)
    rows = np.arange(n)
    seen = np.zeros((n, len(graph.points)), dtype=bool)
    seen[rows, start] = True
    pool = np.full((n, beam), -1, dtype=np.int64)
    far = np.full((n, beam), np.inf)
    pool[:, 0] = start
    far[:, 0] = ((graph.points[start] - queries) ** 2).sum(-1)
    fresh = pool >= 0
    while True:
        rows = np.flatnonzero(fresh.any(axis=1))
        if not len(rows):
            return pool, far
        at = np.where(fresh[rows], far[rows], np.inf).argmin(axis=1)
        fresh[rows, at] = False
        around = layer[pool[rows, at]].astype(np.int64)
        new = (around >= 0) & ~seen[rows[:, None], np.maximum(around, 0)]
        row, place = np.nonzero(new)
        seen[rows[row], around[row, place]] = True
        around = np.where(new, around, 0)
        d = np.where(new, ((graph.points[around] - queries[rows][:, None]) ** 2).sum(-1), np.inf)
        all_d = np.concatenate([far[rows], d], axis=1)
        all_p = np.concatenate([pool[rows], around], axis=1)
        all_f = np.concatenate([fresh[rows], np.isfinite(d)], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        far[rows] = np.take_along_axis(all_d, best, 1)
        pool[rows] = np.where(np.isfinite(far[rows]), np.take_along_axis(all_p, best, 1), -1)
        fresh[rows] = np.take_along_axis(all_f, best, 1) & np.isfinite(far[rows])


def search(graph: Graph, query_ids: np.ndarray, queries: np.ndarray, top: int = TOP, beam: int = BEAM) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, distance): the ``top`` nearest rows found for each query, not its own id."""
    out = []
    start = np.full(len(queries), graph.entry)
    for layer in reversed(graph.layers[1:]):
        start = _walk(graph, layer, queries, start, 1)[0][:, 0]
    pool, _ = _walk(graph, graph.layers[0], queries, start, max(beam, top + 1))
    for query_id, query, found in zip(query_ids.tolist(), queries, pool):
        found = found[found >= 0]
        score = np.sqrt(((graph.points[found] - query) ** 2).sum(axis=1))
        near: list[tuple[float, int]] = []
        for s, p in sorted(zip(score.tolist(), found.tolist())):
            if len(near) > top and s > near[-1][0]:
                break
            # of equal vectors only the smallest ids can be among the nearest
            own = graph.owners[p]
            near += [(s, int(i)) for i in own[own != query_id][:top]]
            near.sort()
        out += [(query_id, i, s) for s, i in near[:top]]
    return out


_FOUND = "query_id bigint, vec_id bigint, score double"


def nearest(df: DataFrame, id_col: str, vector_col: str, is_query: Column, top: int = TOP, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows found for each query, by Euclidean distance.

    Every usable row with an id is in the graph of its shard, by a hash of its
    id; shards keep their size, their number grows with the table.  The queries
    visit every shard, in batches; only the nearest of each shard are merged.
    Vectors of another length than the query's are no candidates.  Rows that
    share the query's id are its own; of queries with one id the smallest
    vector counts.  Ties go to the smaller id; repeated rows are found once each.
    """
    rows = df.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = store(rows.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("dim", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"))
    data = rows.withColumn("dim", F.size("vector")).join(sizes, "dim")
    shard = F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("shards")).cast("int")
    data = data.select("dim", shard.alias("shard"), F.lit(0).alias("turn"), "id", "vector")
    asked = rows.filter("asks").groupBy("id", F.size("vector").alias("dim")).agg(F.min("vector").alias("vector")).join(sizes, "dim")
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    asked = asked.select("dim", every.alias("shard"), F.lit(1).alias("turn"), "id", "vector")
    both = data.unionByName(asked)
    parts = max(1, sum(r[0] for r in sizes.agg(F.sum("shards")).collect() if r[0]))
    parts = min(parts, _MOST_TASKS)
    dealt = both.repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "turn", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, graph = None, [], None
        for batch in batches:
            dims, shards, turns = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.diff(dims) | np.diff(shards) | np.diff(turns)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                ids = batch.column(3).slice(a, b - a).to_numpy()
                values = batch.column(4).slice(a, b - a).flatten().to_numpy()
                vectors = values.reshape(len(ids), -1)
                here = (int(dims[a]), int(shards[a]))
                if here != key:
                    key, held, graph = here, [], None
                if turns[a] == 0:
                    held.append((ids, vectors))
                    continue
                if not held:
                    continue
                if graph is None:
                    graph = build(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
                for at in range(0, len(ids), _QUERIES):
                    found = search(graph, ids[at : at + _QUERIES], vectors[at : at + _QUERIES], top, beam)
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))],
                            ["query_id", "vec_id", "score"],
                        )

    found = dealt.mapInArrow(run, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


_QUERIES = 256
_MOST_TASKS = 20_000
