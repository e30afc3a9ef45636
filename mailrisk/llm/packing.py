"""Packing token pieces into fixed-length sequences: greedy fill, then best two."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.common import over_batches, store
from mailrisk.llm.tokens import worker_encoder

SEQUENCE = 1024
END_ID = 2
#: Pieces a task packs at a time; more would save at most one open sequence per shard.
SHARD_PIECES = 16_384


def cut(n: int, limit: int) -> list[int]:
    """Lengths of the pieces of a document: whole if it fits, else full ones after a shorter first."""
    if n <= limit:
        return [n]
    first = n % limit
    return [first] * (first > 0) + [limit] * (n // limit)


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: Broadcast, end_id: int = END_ID, limit: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each whole text's ids and ``end_id``, cut.

    A null text counts as empty and is the end id alone.
    """
    plain = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = worker_encoder(tokenizer)
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        owner, piece, start, length, crc = [], [], [], [], []
        for row, text in enumerate(batch.column("_text").to_pylist()):
            ids = np.frombuffer(encode(text) + end, dtype=encode.dtype).astype("<u4")
            at = 0
            for k, n in enumerate(cut(len(ids), limit)):
                owner.append(row)
                piece.append(k)
                start.append(at)
                length.append(n)
                crc.append(zlib.crc32(ids[at : at + n]))
                at += n
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(owner, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    kind = plain.schema["doc_id"].dataType.simpleString()
    return over_batches(plain, run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_two_fit(lengths: np.ndarray, limit: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; every bin holds at most ``limit``.

    A bin takes the longest document left, then the longest that still fits,
    until none does.  Then its smallest document makes room, again and again,
    for the two unpacked documents that together fill the widened gap more
    tightly than it did.
    """
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    first = np.searchsorted(sorted_lengths, np.arange(limit + 2))
    left = np.diff(first)  # unpacked documents of each length
    taken = np.zeros(limit + 1, dtype=np.int64)  # documents of a length given out so far
    left = left.copy()
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    n_left, longest, number = len(lengths), limit, 0
    while n_left:
        while not left[longest]:
            longest -= 1
        held: list[int] = []
        gap, size = limit, longest
        while True:
            while size > 0 and not left[size]:
                size -= 1
            if size <= 0:
                break
            fit = min(int(left[size]), gap // size)
            held += [size] * fit
            left[size] -= fit
            n_left -= fit
            gap -= size * fit
            size = min(gap, size - 1 if left[size] == 0 or fit == 0 else size)
        while gap and n_left > 1:
            small = held[-1]
            room = gap + small
            sizes = np.flatnonzero(left[: room])  # what could be the longer of the two
            if len(sizes) == 0:
                break
            other = np.minimum(room - sizes, sizes)
            at = np.searchsorted(sizes, other, side="right") - 1
            mate = sizes[np.maximum(at, 0)]
            alone = (at >= 0) & (mate == sizes) & (left[sizes] < 2)
            mate = np.where(alone, sizes[np.maximum(at - 1, 0)], mate)
            valid = (at >= 0) & ~(alone & (at == 0))
            both = np.where(valid, sizes + mate, 0)
            best = int(np.argmax(both))
            if both[best] <= small:
                break
            held.pop()
            left[small] += 1
            for s in (int(sizes[best]), int(mate[best])):
                held.append(s)
                left[s] -= 1
            held.sort(reverse=True)
            n_left -= 1
            gap = room - int(both[best])
        at = 0
        for s in held:
            row = order[first[s] + taken[s]]
            taken[s] += 1
            bins[row], offsets[row] = number, at
            at += s
        number += 1
    return bins, offsets


_PACKED = "piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def pack(table: DataFrame, limit: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Give each row of a stored piece table a ``sequence_id`` and an ``offset`` in it.

    A full piece is a sequence by itself and is not moved.  The others are
    dealt evenly to shards by their place in the table, so equal rows spread;
    each shard is packed alone.  Shards stay the same size however many rows
    there are.
    """
    full = table.filter(F.col("length") >= limit).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    part = table.filter(F.col("length") < limit)
    shards = max(1, -(-part.count() // shard_pieces))
    dealt = part.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    names = [*table.columns, "sequence_id", "offset"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_two_fit(rows["length"].to_numpy(), limit)
        return rows.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)[names]

    kind = table.schema["doc_id"].dataType.simpleString()
    packed = dealt.groupBy("_shard").applyInPandas(run, f"doc_id {kind}, {_PACKED}")
    return full.unionByName(packed)


def pack_documents(df: DataFrame, id_col: str, text_col: str, tokenizer: Broadcast, end_id: int = END_ID, limit: int = SEQUENCE) -> DataFrame:
    """One row per piece of each document, with its sequence and place there.

    Every row is a document of its own, also repeated ones and those with a
    null id; a null or empty text is its end id alone.  Texts are encoded once,
    however long; the small piece table is stored.  An empty table gives no row.
    Which of equally good bins takes a piece follows the order of the pieces, so
    sequence numbers may differ between runs, their contents' fit not.
    """
    return pack(store(pieces(df, id_col, text_col, tokenizer, end_id, limit), "pieces"), limit)
