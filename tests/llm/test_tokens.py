import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailrisk.llm import packing, token_file
from mailrisk.llm.queries import QUERIES
from mailrisk.llm.tokens import worker_encoder
from mailrisk.session import scratch_path


def _crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_the_library(tokenizer, plain_tokenizer):
    encode, rnd = worker_encoder(tokenizer), random.Random(5)
    common = " \t\n\r'stredmvlai.,!?-|09²é’“…ß ſ¡×÷ºª<>ol"
    texts = ["", "<|endoftext|>", " leading", "trailing  ", "a\n\n b", "it's 'LL we'll 've", "日本 語", "a\x0bb\x1c \x85c"]
    texts += ["".join(rnd.choice(common) for _ in range(rnd.randrange(40))) for _ in range(4000)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 0x300), rnd.randrange(0x2000, 0x2070), 0x1F600])) for _ in range(20)) for _ in range(500)]
    for t in texts:
        ids = plain_tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t), dtype=encode.dtype).tolist() == ids, repr(t)
    assert encode(None) == b""


@pytest.mark.parametrize("limit", [4, 6, 18])
def test_code_lengths_are_best_within_the_limit(limit):
    rng = np.random.default_rng(limit)
    for n in (1, 2, 3, 9, 16):
        counts = rng.integers(1, 1000, n) ** 2
        bits = token_file.code_lengths(counts, limit)
        assert bits.max() <= limit
        if n > 1:
            assert (0.5**bits).sum() == 1
        if n <= 9 and n > 1:
            assert (bits * counts).sum() == _best(sorted(counts.tolist(), reverse=True), limit)
    with pytest.raises(ValueError):
        token_file.code_lengths(np.ones(17), 4)


def _best(counts, limit):
    """Least total bits over all full code trees, by the number of codes of each length."""
    from functools import lru_cache

    @lru_cache(None)
    def least(i, depth, free):  # free: nodes at this depth
        if i == len(counts):
            return 0 if free == 0 else float("inf")
        if depth > limit or free == 0 or free > len(counts) - i:
            return float("inf")
        return min(depth * sum(counts[i : i + k]) + least(i + k, depth + 1, 2 * (free - k)) for k in range(free + 1))

    return least(0, 1, 2)


def test_codes_are_canonical_and_round_trip():
    rng = np.random.default_rng(1)
    symbols = np.sort(rng.choice(50_000, 700, replace=False))
    p = rng.random(700) ** 8
    ids = rng.choice(symbols, 40_000, p=p / p.sum())
    ids[:700] = symbols
    bits = token_file.code_lengths(np.bincount(ids)[symbols], 12)
    codes = token_file.canonical_codes(bits)
    order = np.lexsort((symbols, bits))
    texts = [f"{codes[i]:0{bits[i]}b}" for i in order]
    assert texts == sorted(texts) and not any(b.startswith(a) for a, b in zip(texts, texts[1:]))
    book = token_file.Codebook(symbols, bits)
    counts = np.array([1, 255, 256, 257, 1, 513] + [7] * 100)
    counts = np.append(counts, len(ids) - counts.sum())
    data, n_bytes, marks = book.encode(ids, counts)
    written = "".join("".join(f"{codes[np.searchsorted(symbols, i)]:0{bits[np.searchsorted(symbols, i)]}b}" for i in ids[:1]).ljust(8, "0") for _ in [0])
    assert f"{data[0]:08b}"[: len(written.rstrip("0"))] == written.rstrip("0")
    back = token_file.decode_block(book, counts, n_bytes, marks.astype("<u4").tobytes(), data.tobytes())
    assert (back == ids).all()
    # a block decodes from a checkpoint alone
    start = (np.cumsum(n_bytes) - n_bytes)[-1] * 8 + marks[-2]
    alone = book.decode(data, np.array([start]), np.array([100]))
    whole = -(-counts[-1] // token_file.CHECKPOINT)
    first = ids[-counts[-1] :][(whole - 2) * token_file.CHECKPOINT :]
    assert (alone == first[:100]).all()


def _expected(rows, encode, end):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, at, len(ids), _crc(ids)))
        at += len(ids)
    return out


def test_token_file_query(spark, sf_dir, plain_tokenizer):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op3_token_file"](spark, sf_dir).collect()))
    assert got == _expected(rows, plain_tokenizer.encode, 0)


def test_token_files_of_odd_rows_over_many_parts(spark, odd_docs, tokenizer, plain_tokenizer):
    path = scratch_path(spark, "tokens")
    token_file.write_token_files(odd_docs.repartition(3), "doc_id", "text", tokenizer, path, part_bytes=40_000)
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() > 1
    got = token_file.read_token_files(spark, path).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    assert sorted(r["n_tokens"] for r in got) == sorted(n for _, _, n, _ in _expected(rows, plain_tokenizer.encode, 0))
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1].tolist()
    assert [r["doc_id"] is not None for r in ordered] == [False] + [True] * (len(rows) - 1)
    assert [r["doc_id"] for r in ordered[1:]] == sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, set()).add(_crc(plain_tokenizer.encode(text or "", add_special_tokens=False).ids + [0]))
    assert all(zlib.crc32(r["ids"]) in texts[r["doc_id"]] for r in got)
    empty = scratch_path(spark, "tokens")
    token_file.write_token_files(odd_docs.limit(0), "doc_id", "text", tokenizer, empty)
    assert token_file.read_token_files(spark, empty).count() == 0


def _check_packing(rows, texts, encode, limit=1024):
    """Every id of every document in one place, sequences gapless and within the limit."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in texts.items():
        ids = encode(text or "", add_special_tokens=False).ids + [2]
        parts = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["length"] for r in parts[1:]] == [limit] * (len(parts) - 1) or len(ids) <= limit
        at = 0
        for r in parts:
            assert r["start"] == at and r["ids_crc32"] == _crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids) and len(parts) == max(1, -(-len(ids) // limit))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit
    return len(by_sequence)


def test_packing_query(spark, sf_dir, plain_tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_packing"](spark, sf_dir).collect()
    used = _check_packing(rows, texts, plain_tokenizer.encode)
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert used <= 1.03 * least + 1


def test_packing_odd_rows(spark, odd_docs, tokenizer, plain_tokenizer):
    docs = odd_docs.filter("doc_id <> 5 AND doc_id IS NOT NULL")
    got = packing.pack_documents(docs, "doc_id", "text", tokenizer).collect()
    _check_packing(got, {r["doc_id"]: r["text"] for r in docs.collect()}, plain_tokenizer.encode)
    twice = packing.pack_documents(odd_docs, "doc_id", "text", tokenizer).collect()
    assert sum(r["piece"] == 0 for r in twice) == odd_docs.count()
    assert packing.pack_documents(odd_docs.limit(0), "doc_id", "text", tokenizer).count() == 0


def test_shards_spread_equal_rows(spark):
    rows = spark.range(3000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(300).cast("bigint").alias("length"), F.lit(9).cast("bigint").alias("ids_crc32"))
    path = scratch_path(spark, "pieces")
    rows.write.parquet(path)
    got = packing.pack(spark.read.parquet(path), shard_pieces=500)
    sizes = got.groupBy(F.shiftright("sequence_id", 32).alias("s")).count().collect()
    assert len(sizes) == 6 and max(r["count"] for r in sizes) < 700
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_best_two_fit():
    rng = np.random.default_rng(0)
    for lengths in ([], [5], [1024], [600, 500, 424, 300, 224], rng.integers(1, 1024, 2000), rng.integers(200, 400, 999), np.full(50, 512)):
        lengths = np.array(lengths, dtype=np.int64)
        bins, offsets = packing.best_two_fit(lengths)
        for b in np.unique(bins):
            rows = np.flatnonzero(bins == b)
            rows = rows[np.argsort(offsets[rows])]
            assert lengths[rows].sum() <= 1024
            assert offsets[rows].tolist() == (np.cumsum(lengths[rows]) - lengths[rows]).tolist()
    # greedy takes 600 + 400; the 400 makes way for 212 + 212, which fill the bin
    bins, _ = packing.best_two_fit(np.array([600, 400, 212, 212, 399, 399]))
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_cut():
    assert packing.cut(1, 1024) == [1] and packing.cut(1024, 1024) == [1024]
    assert packing.cut(1025, 1024) == [1, 1024] and packing.cut(2048, 1024) == [1024, 1024]
