"""Token-ID files: canonical length-limited Huffman codes, blocks, bit-offset checkpoints.

The format is a folder with two Parquet tables.  ``codebook`` has (id, bits):
the code length of each id, from which the canonical code follows.  ``blocks``
has one row per run of documents in ascending id order: ids and token counts of
its documents, the byte length of each document's bit string, the bit offset of
every ``CHECKPOINT``-th token, and the bytes.  A document starts on a byte, and a
block needs nothing but the codebook, so blocks and checkpoints decode alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailrisk.llm.common import over_batches, store
from mailrisk.llm.tokens import worker_encoder
from mailrisk.operators.joins import lookup_join

END_ID = 0
MAX_CODE_BITS = 18
CHECKPOINT = 256
BLOCK_TOKENS = 1 << 18
#: Bytes of text per part of the id range.
PART_BYTES = 64 << 20
_STEP_BYTES = 1 << 20


def token_ids(df: DataFrame, id_col: str, text_col: str, tokenizer: Broadcast, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): each whole text's ids and ``end_id``, little-endian; a null text counts as empty."""
    plain = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = worker_encoder(tokenizer)
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        ids = [encode(t) + end for t in batch.column("_text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return over_batches(plain, run, "doc_id bigint, ids binary")


def id_counts(ids: DataFrame, dtype: str) -> pd.DataFrame:
    """(id, n) over all documents, by id: at most one row per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            column = batch.column("ids")  # its documents lie end to end in one buffer
            first, last = np.frombuffer(column.buffers()[1], dtype=np.int32)[[column.offset, column.offset + len(column)]]
            ids = np.frombuffer(column.buffers()[2], dtype=np.uint8)[first:last].view(dtype)
            found = np.bincount(ids, minlength=len(total))
            found[: len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")


def code_lengths(counts: np.ndarray, limit: int = MAX_CODE_BITS) -> np.ndarray:
    """Code length of each symbol: the least total bits with no code over ``limit`` (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols have no code of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    items, is_leaf = leaves, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        even = items[: len(items) // 2 * 2]
        merged = np.concatenate([leaves, even[0::2] + even[1::2]])
        by = np.argsort(merged, kind="stable")
        items = merged[by]
        is_leaf.append(by < n)
    lengths, wanted = np.zeros(n, dtype=np.int64), 2 * n - 2
    for level in reversed(is_leaf):
        chosen = int(level[:wanted].sum())
        lengths[:chosen] += 1
        wanted = 2 * (wanted - chosen)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol): each is the one before plus one, shifted to its length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    codes, code, last = np.zeros(len(lengths), dtype=np.int64), 0, 0
    for i in order:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Codebook:
    """Both directions of a canonical code; ``table`` has id and length for each run of bits."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        codes = canonical_codes(bits)
        size = int(ids.max(initial=0)) + 1
        self.bits = np.zeros(size, dtype=np.int64)
        self.codes = np.zeros(size, dtype=np.uint64)
        self.bits[ids], self.codes[ids] = bits, codes
        self.width = int(bits.max(initial=1))
        order = np.argsort(codes << (self.width - bits), kind="stable")
        entries = ids[order].astype(np.uint32) << np.uint32(8) | bits[order].astype(np.uint32)
        self.table = np.zeros(1 << self.width, dtype=np.uint32)
        filled = np.repeat(entries, 1 << (self.width - bits[order]))
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, byte length of each document, checkpoint bit offsets) of documents laid end to end."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        doc_bits = np.diff(ends[np.cumsum(counts) - 1], prepend=0)
        doc_bytes = (doc_bits + 7) >> 3
        shift = (np.cumsum(doc_bytes) - doc_bytes) * 8 - (np.cumsum(doc_bits) - doc_bits)
        at = ends - bits + np.repeat(shift, counts)
        # a code lies in one 32-bit word or two; codes of a word add up, as their bits are apart
        place = at >> 5
        window = self.codes[ids] << (64 - bits - (at & 31)).astype(np.uint64)
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        total = int(doc_bytes.sum())
        words = np.zeros(total // 4 + 2, dtype=np.uint64)
        words[place[starts]] += np.add.reduceat(window >> np.uint64(32), starts)
        words[place[starts] + 1] += np.add.reduceat(window & np.uint64(0xFFFFFFFF), starts)
        data = words.astype(">u4").view(np.uint8)[:total]
        first = np.cumsum(counts) - counts
        marks = [np.arange(f, f + n, CHECKPOINT) for f, n in zip(first.tolist(), counts.tolist())]
        n_marks = [len(m) for m in marks]
        start = (np.cumsum(doc_bytes) - doc_bytes) * 8
        offsets = at[np.concatenate(marks)] - np.repeat(start, n_marks)
        return data, doc_bytes, offsets

    def decode(self, data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of the segments that begin at the given bits, laid end to end.

        All segments advance together, one table look-up per step.
        """
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
        words = padded[:-3] << np.uint32(24) | padded[1:-2] << np.uint32(16) | padded[2:-1] << np.uint32(8) | padded[3:]
        order = np.argsort(-counts, kind="stable")
        at, n = starts[order].copy(), counts[order]
        first = (np.cumsum(counts) - counts)[order]
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        down = np.uint32(32 - self.width)
        active = len(n)
        for step in range(int(n[0]) if len(n) else 0):
            while active and n[active - 1] <= step:
                active -= 1
            here = at[:active]
            entry = self.table[words[here >> 3] << (here & 7).astype(np.uint32) >> down]
            out[first[:active] + step] = entry >> np.uint32(8)
            here += (entry & np.uint32(255)).astype(np.int64)
        return out


def range_bounds(df: DataFrame, id_col: str, text_col: str, part_bytes: int = PART_BYTES) -> list[int]:
    """Ids that cut the id range into parts of about ``part_bytes`` of text."""
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    if parts == 1:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = df.agg(F.percentile_approx(id_col, shares, F.lit(max(10_000, 20 * parts)))).first()[0]
    return sorted(set(found or []))


_ENCODED = "part int, doc_id bigint, n_tokens bigint, checkpoints binary, data binary"
_BLOCK = "part int, block int, first_token bigint, doc_ids array<bigint>, n_tokens array<bigint>, n_bytes array<bigint>, checkpoints binary, data binary"


def _encoded(ids: DataFrame, book: Codebook, bounds: list[int], dtype: str) -> DataFrame:
    cuts = np.array(bounds, dtype=np.int64)

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs = batch.column("ids").to_pylist()
        counts = np.array([len(d) for d in docs], dtype=np.int64) // np.dtype(dtype).itemsize
        data, n_bytes, offsets = book.encode(np.frombuffer(b"".join(docs), dtype=dtype).astype(np.int64), counts)
        raw, marks = data.tobytes(), offsets.astype("<u4").tobytes()
        ends, mark_ends = np.cumsum(n_bytes).tolist(), np.cumsum(-(-counts // CHECKPOINT) * 4).tolist()
        keys = batch.column("doc_id")
        known = keys.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.searchsorted(cuts, known, side="right").astype(np.int32)),
                keys,
                pa.array(counts),
                pa.array([marks[a:b] for a, b in zip([0, *mark_ends], mark_ends)], pa.binary()),
                pa.array([raw[a:b] for a, b in zip([0, *ends], ends)], pa.binary()),
            ],
            ["part", "doc_id", "n_tokens", "checkpoints", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few hundred documents at a time: working memory does not follow the batch
            sizes = np.cumsum([len(d.as_buffer()) for d in batch.column("ids")]) // _STEP_BYTES
            starts = np.flatnonzero(np.diff(sizes, prepend=-1)) if batch.num_rows else []
            for at, to in zip(starts, [*starts[1:], batch.num_rows]):
                yield coded(batch.slice(at, to - at))

    return ids.mapInArrow(run, _ENCODED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in (part, doc_id) order to blocks."""
    part, block, first, held, size = None, 0, 0, [], 0

    def flush() -> pa.RecordBatch:
        ids, tokens, marks, data = zip(*held)
        row = {
            "part": part, "block": block, "first_token": first, "doc_ids": list(ids), "n_tokens": list(tokens),
            "n_bytes": [len(d) for d in data], "checkpoints": b"".join(marks), "data": b"".join(data),
        }
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

    for batch in batches:
        for p, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if held and (p != part or size >= BLOCK_TOKENS):
                yield flush()
                block, first, held, size = block + 1, first + size, [], 0
            if p != part:
                part, block, first = p, 0, 0
            held.append(row)
            size += row[1]
    if held:
        yield flush()


_BLOCK_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())),
        ("checkpoints", pa.binary()), ("data", pa.binary()),
    ]
)


def write_token_files(
    df: DataFrame, id_col: str, text_col: str, tokenizer: Broadcast, path: str,
    end_id: int = END_ID, max_code_bits: int = MAX_CODE_BITS, part_bytes: int = PART_BYTES,
) -> None:
    """Write all texts of ``df`` to token files below ``path``.

    Texts are encoded once into a stored id table; the code comes from the
    counts of all ids.  Only coded documents are shuffled, to the part of the
    id range they belong to.  Null texts are empty, null ids come first,
    repeated ids stay as often as given, in the order of their lengths and coded
    bytes, an empty table gives empty files.
    """
    spark = df.sparkSession
    dtype = _id_type(tokenizer)
    ids = store(token_ids(df, id_col, text_col, tokenizer, end_id), "token-ids", compression="zstd")
    counts = id_counts(ids, dtype)
    symbols = counts["id"].to_numpy(dtype=np.int64)
    bits = code_lengths(counts["n"].to_numpy(), max_code_bits)
    rows = pd.DataFrame({"id": symbols, "bits": bits})
    spark.createDataFrame(rows, "id bigint, bits bigint").coalesce(1).write.parquet(f"{path}/codebook")
    bounds = range_bounds(df, id_col, text_col, part_bytes)
    coded = _encoded(ids, Codebook(symbols, bits), bounds, dtype)
    placed = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "n_tokens", "data")
    placed.mapInArrow(_blocks, _BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _id_type(tokenizer: Broadcast) -> str:
    return worker_encoder(tokenizer).dtype


def read_codebook(spark: SparkSession, path: str) -> Codebook:
    """The codebook, at most one row per id of the vocabulary."""
    rows = spark.read.parquet(f"{path}/codebook").toPandas().sort_values("id")
    return Codebook(rows["id"].to_numpy(dtype=np.int64), rows["bits"].to_numpy(dtype=np.int64))


def decode_block(book: Codebook, n_tokens: np.ndarray, n_bytes: np.ndarray, checkpoints: bytes, data: bytes) -> np.ndarray:
    """All ids of a block, decoded from every checkpoint at once."""
    n_marks = -(-n_tokens // CHECKPOINT)
    first = (np.cumsum(n_bytes) - n_bytes) * 8
    starts = np.frombuffer(checkpoints, dtype="<u4").astype(np.int64) + np.repeat(first, n_marks)
    counts = np.full(len(starts), CHECKPOINT, dtype=np.int64)
    counts[np.cumsum(n_marks) - 1] = n_tokens - (n_marks - 1) * CHECKPOINT
    return book.decode(np.frombuffer(data, dtype=np.uint8), starts, counts)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files, ids as little-endian 32-bit bytes.

    ``start`` counts the ids of all documents before it in ascending order.
    """
    return _read(spark, path, "ids binary", lambda ids: ids.tobytes(), pa.binary())


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): as ``read_token_files``, with a checksum of the ids."""
    return _read(spark, path, "ids_crc32 bigint", zlib.crc32, pa.int64())


def _read(spark: SparkSession, path: str, field: str, value, kind: pa.DataType) -> DataFrame:
    book = read_codebook(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row per part: the ids before a part are those of all parts before it
    sizes = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    sizes = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    named = lookup_join(blocks, before, "part", spread="block", how="inner").select(
        (F.col("before") + F.col("first_token")).alias("first"), "doc_ids", "n_tokens", "n_bytes", "checkpoints", "data"
    )
    name = field.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                n_tokens = row["n_tokens"].values.to_numpy()
                ids = decode_block(
                    book, n_tokens, row["n_bytes"].values.to_numpy(), row["checkpoints"].as_py(), row["data"].as_buffer()
                ).astype("<u4", copy=False)
                ends = np.cumsum(n_tokens)
                starts = ends - n_tokens
                values = [value(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(starts + row["first"].as_py()), pa.array(n_tokens), pa.array(values, kind)],
                    ["doc_id", "start", "n_tokens", name],
                )

    return named.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {field}")
