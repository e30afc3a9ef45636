"""Ranked lexical search, reversed: the items' terms are the index and the documents run through it.

The inverted index of a slice of the items (term -> items) goes to every task.
Each document's counts of those terms are scored against all items of the slice
at once, and each task keeps the best documents of every item in a heap of fixed
size; the heaps are merged.  Documents never meet in a join and are never
shuffled, however frequent a term is.

* null text: no term; such a document counts nowhere.  A null document id is
  ranked after all other ids of its score, a null item id is an id like others.
* empty tables: no rows.  Items without a term, or whose terms no document has,
  have no rows.  Texts are read whole, however long.
* Equal scores rank by ascending id.  Repeated document rows are ranked singly;
  repeated item rows are one item; texts that share an item id are ranked apart.
* Other columns of either table are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailrisk.llm.common import store
from mailrisk.llm.tokenize import BREAK, byte_table, numbered, text_chunks, word_runs

#: A term is a run of these bytes: digits, letters, and all of every character beyond ASCII.
_TABLE = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)

#: Bytes of item text whose index is broadcast at once; more items make more slices.
SLICE_BYTES = 16 << 20
#: Cells of a score matrix, and of the terms spread over items, held at once.
CELLS = 1 << 21
#: Groups in which the heaps of the tasks are merged before the last merge.
MERGE_GROUPS = 16

# The ranking rule (fixed values): weight scale, saturation, and length share in percent.
SCALE, SATURATION, LENGTH = 1000, 12, 25


def terms(text: str | None) -> list[bytes]:
    return [t for run in word_runs([(text or "").encode()], _TABLE) for t in run]


class _Known(dict):
    """Numbers of the slice's terms; -1 for any other, without keeping it."""

    def __missing__(self, term: bytes) -> int:
        return -1


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term: all its terms, and counts of those in the vocabulary."""
    numbers = {t: i for i, t in enumerate(vocabulary)} | {BREAK: -2}
    wide = max(1, len(vocabulary))
    # the text is copied: two equal names, or the id as the text, are one column otherwise
    df = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("id", df.schema["id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(numbers)
        for batch in batches:
            ids, texts = batch.columns
            for first, held in text_chunks(texts):
                number = numbered(held, _TABLE, known.__getitem__)
                doc = np.cumsum(number == -2)
                n = np.bincount(doc[number != -2], minlength=len(held))
                hit = number >= 0
                key, tf = np.unique(doc[hit] * wide + number[hit], return_counts=True)
                keep = np.flatnonzero(n)
                ends = np.searchsorted(key, (keep + 1) * wide)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(keep + first)),
                        pa.array(n[keep], pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(key % wide, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64())),
                    ],
                    names=schema.names,
                )

    return df.mapInArrow(run, schema)


class _Index:
    """term -> items with how often they hold it, as flat arrays, and the terms' weights."""

    def __init__(self, items: list[list[bytes]], vocabulary: list[bytes]) -> None:
        numbers = {t: i for i, t in enumerate(vocabulary)}
        wide = max(1, len(items))
        keys = [numbers[t] * wide + i for i, found in enumerate(items) for t in found]
        key, self.times = np.unique(np.array(keys, np.int64), return_counts=True)
        self.items = key % wide
        self.starts = np.searchsorted(key, np.arange(len(vocabulary) + 1) * wide)
        self.weights = np.zeros(len(vocabulary), np.int64)
        self.size = len(items)

    def scores(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """(documents, items): all scores of a few documents, in exact whole numbers."""
        gain = self.weights[term] * ((10**9 * tf) // (SCALE * tf + SATURATION * m[doc]))
        degree = self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(degree)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[term] - (ends - degree), degree)
        value = np.repeat(gain, degree) * self.times[at]
        cell = np.repeat(doc, degree) * self.size + self.items[at]
        cells = len(m) * self.size
        # sums of doubles are exact below 2^53: both halves of each value are summed apart
        low = np.bincount(cell, value & 0xFFFFFFFF, cells).astype(np.int64)
        high = np.bincount(cell, value >> 32, cells).astype(np.int64)
        return (low + (high << 32)).reshape(len(m), self.size)


def _first_of_each(rows: pa.Table, top: int) -> pa.Table:
    """The ``top`` best rows of every item: score descending, then id ascending with null last."""
    order = pc.sort_indices(rows, [("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end")
    rows = rows.take(order)
    item = rows["item"].to_numpy()
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
    place = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
    return rows.filter(pa.array(place < top))


def _ranked_slice(df: DataFrame, items: DataFrame, rows: list, id_type: T.DataType, top: int) -> DataFrame:
    """Best documents of one slice of the items: (item columns, doc_id, score)."""
    found = [terms(r["text"]) for r in rows]
    vocabulary = sorted({t for f in found for t in f})
    index = _Index(found, vocabulary)
    listed = store(postings(df, "id", "text", vocabulary), "postings")
    stats = listed.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, n_terms = int(stats[0]), int(stats[1] or 0)
    # one row per term of the slice
    for term, df_ in listed.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        index.weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df_ + 1)))
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("id", id_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, least = None, np.ones(index.size, np.int64)  # a score of 0 is none
        for batch in batches:
            ids, n = batch.column(0), batch.column(1).to_numpy()
            lists = batch.column(2)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            tfs = batch.column(3).values.to_numpy()
            # documents a step: no more cells than CELLS, in the matrix and in what is spread over it
            spread = np.r_[0, np.cumsum(index.starts[flat + 1] - index.starts[flat])][offsets - 0]
            a = 0
            while a < len(n):
                b = min(a + max(1, CELLS // index.size), int(np.searchsorted(spread, spread[a] + CELLS, "right")) - 1, len(n))
                b = max(b, a + 1)
                part = slice(offsets[a], offsets[b])
                doc = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
                m = 100 - LENGTH + (LENGTH * n[a:b] * n_docs) // n_terms
                score = index.scores(doc, flat[part].astype(np.int64), tfs[part], m)
                kept = max(0, b - a - top)
                bar = np.maximum(least, np.partition(score, kept, axis=0)[kept] if b - a > top else 0)
                row, item = np.nonzero(score >= bar)
                if len(row):
                    new = pa.table({"item": pa.array(item, pa.int32()), "score": score[row, item], "id": ids.take(pa.array(row + a))})
                    heaps = _first_of_each(new if heaps is None else pa.concat_tables([heaps, new]), top)
                    held, counts = np.unique(heaps["item"].to_numpy(), return_counts=True)
                    last = np.cumsum(counts) - 1
                    full = counts == top
                    least[held[full]] = heaps["score"].to_numpy()[last[full]]
                a = b
        if heaps is not None:
            yield from heaps.combine_chunks().to_batches()

    heaps = listed.mapInArrow(run, schema)
    best = Window.partitionBy("item", "g").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    grouped = heaps.withColumn("g", F.pmod(F.xxhash64("id", "score"), F.lit(MERGE_GROUPS)))
    merged = grouped.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top).drop("g")
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = merged.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top)
    numbered = df.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), items.schema["item_id"]]))
    # one row per item of the slice
    return ranked.join(F.broadcast(numbered), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def search(
    docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str,
    top: int = 20, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item, best first.

    Items are taken in slices by a hash of their row, about ``slice_bytes`` of
    text each, and every slice reads the documents once.  A slice, and the
    document counts of its terms, pass through the driver on the way to the tasks.
    """
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    asked = asked.filter("text IS NOT NULL").distinct()
    df = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = df.schema["id"].dataType
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    slices = -(-size // slice_bytes)
    found = []
    for k in range(slices):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()  # about slice_bytes
        if rows:
            found.append(_ranked_slice(df, asked, rows, id_type, top))
    if not found:
        schema = T.StructType([asked.schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS t FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
i AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest({_TERMS}) AS term FROM i) GROUP BY ALL),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor({SCALE} * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
m AS (SELECT r, doc_id, (100 - {LENGTH} + (({LENGTH} * len(t) * n_docs) // n_terms))::BIGINT AS m FROM d, s WHERE len(t) > 0),
g AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // ({SCALE} * tf + {SATURATION} * m)) AS gain FROM p JOIN w USING (term) JOIN m USING (r)),
x AS (SELECT item_id, text, r, doc_id, sum(times * gain)::BIGINT AS score FROM q JOIN g USING (term) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 20
"""
