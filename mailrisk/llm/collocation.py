"""Phrases whose words stand together more often than chance, from exact counts of all n-grams.

1. Each task counts the n-grams of a shard of bounded size, sorts them and builds
   a count transducer from them (``automaton``), cut at the ends of prefix ranges.
2. The transducers of a range are united and their weights summed; n-grams below
   the least count go, as no part of a candidate can be rarer than it.
3. The parts of the candidates of a range are an automaton themselves.  Cut at the
   same ends, its pieces are composed with the transducers of the ranges they fall
   in, which gives the counts of the parts, and the longer phrases each one is in.
4. A range is scored once all its answers are back.

A range is a stretch of the sorted n-grams, not a word: a hot word or pair of
words spreads over ranges, and a hot n-gram is one count per shard.  Asked parts
are sent once per range, not once per candidate.  The ends of ranges come from a
sample; they only even out the work.

* null text: no words; null language: ``und``, together with the language of that
  name.  Texts are read whole; a text longer than a shard is counted over several.
* Repeated rows count each time.  Empty table: no rows.  Other columns are not read.
* Equal scores: the larger count first, then the smaller phrase in byte order.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailrisk.llm.automaton import Automaton, Columns, cut_place, look_up, numbers_in, sort_order, union
from mailrisk.llm.common import store
from mailrisk.llm.tokenize import BREAK, byte_table, numbered, text_chunks

#: Blanks end a word, marks and line ends also end a piece.
_TABLE = byte_table(lambda b: b not in (0x20, 0x09), lambda b: b in b".,;:!?\n\x0b\x0c\r")

MAX_WORDS = 3
MIN_COUNT = 10
SCALE = 1_000_000
#: A phrase goes if a longer one has at least this share of its count, in percent.
COVER = 50
TOP = 2000

#: Words a shard counts at most, and so what a task holds.
SHARD_WORDS = 2_500_000
#: Text bytes per prefix range, by the memory of a task (about 40 bytes per byte of text at most), and most ranges:
#: the ends of ranges, of at most 48 bytes a word, go to all tasks.
RANGE_BYTES = 8 << 20
MAX_RANGES = 1 << 18
_CUT_BYTES = 48
_MARK_EVERY = 256

Cut = tuple[bytes, tuple[bytes, ...]]

_ROWS = "lang string, range long, asker long, n long, data binary"


class _Numbers(dict):
    """Numbers of words in the order they are first met, from 1; 0 for a break."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Shard:
    """Words of one language not counted yet."""

    def __init__(self) -> None:
        self.numbers, self.held, self.size = _Numbers(), [], 0

    def add(self, texts: list[bytes]) -> None:
        found = np.r_[numbered(texts, _TABLE, self.numbers.__getitem__), 0]
        self.held.append(found.astype(np.int32))
        self.size += len(found)

    def take(self, depth: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, int]]:
        """(sorted words, sorted packed n-grams, counts, words counted) of all that is held, in steps of bounded size."""
        flat = np.concatenate(self.held)
        names = list(self.numbers)
        self.__init__()
        bits = 62 // depth
        # distinct words of a step stay below what the bits of a place can tell apart
        step = min(SHARD_WORDS, (1 << bits) - depth - 1)
        for a in range(0, len(flat), step):
            part = flat[a : a + step + depth - 1]
            used = np.unique(part)
            used = used[used > 0]
            order = sorted(used.tolist(), key=names.__getitem__)
            rank = np.zeros(len(names), np.int64)
            rank[order] = np.arange(1, len(order) + 1)
            word = np.r_[rank[part], np.zeros(depth, np.int64)]
            n = min(step, len(flat) - a)
            key, alive, grams = np.zeros(n, np.int64), np.ones(n, bool), []
            for k in range(depth):
                here = word[k : k + n]
                alive = alive & (here > 0)
                key = key | (here << (bits * (depth - 1 - k)))
                grams.append(key[alive])
            total = len(grams[0])
            grams = np.concatenate(grams)
            grams.sort()
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[first, len(grams)])
            yield [names[i] for i in order], grams[first], counts, total


def _unpacked(key: np.ndarray, depth: int) -> Columns:
    bits = 62 // depth
    return [(key >> (bits * (depth - 1 - k))) & ((1 << bits) - 1) for k in range(depth)]


def _slices(cuts: list[Cut], lang: str, words: list[bytes], columns: Columns, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(range, automaton) of sorted sequences, cut where ranges end."""
    code = lang.encode()
    low, high = bisect.bisect_left(cuts, (code, ())), bisect.bisect_left(cuts, (code + b"\x00", ()))
    ends = np.r_[0, np.array([cut_place(c[1], words, columns) for c in cuts[low:high]], np.int64), len(counts)]
    for i in np.flatnonzero(np.diff(ends)):
        part = slice(ends[i], ends[i + 1])
        yield low + int(i), Automaton.build(words, [c[part] for c in columns], counts[part]).to_bytes()


def _by_language(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray, int]]:
    """Counted shards of the rows (text, lang) of a task."""
    shards: dict[str, _Shard] = {}
    for batch in batches:
        texts, langs = batch.column(0), batch.column(1).to_pylist()
        for first, held in text_chunks(texts):
            groups: dict[str, list[bytes]] = {}
            for lang, text in zip(langs[first : first + len(held)], held):
                groups.setdefault(lang, []).append(text)
            for lang, group in groups.items():
                shards.setdefault(lang, _Shard()).add(group)
            if sum(s.size for s in shards.values()) >= SHARD_WORDS:
                for lang, shard in shards.items():
                    for found in shard.take(depth):
                        yield lang, *found
                shards.clear()
    for lang, shard in shards.items():
        for found in shard.take(depth):
            yield lang, *found


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    lang, at, asker, n, data = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(at, pa.int64()), pa.array(asker, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())],
        names=["lang", "range", "asker", "n", "data"],
    )


def _range_ends(df: DataFrame, depth: int) -> list[Cut]:
    """Where ranges end: evenly spaced n-grams of a sample of the texts."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    ranges = min(MAX_RANGES, (size or 0) // RANGE_BYTES + 1)
    if ranges == 1:
        return []
    sample = df.sample(min(1.0, max(2000, 8 * ranges) / rows), seed=42)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, key, _, _ in _by_language(batches, depth):
            columns = _unpacked(key[_MARK_EVERY // 2 :: _MARK_EVERY], depth)
            found = [b"\n".join(words[w - 1][:_CUT_BYTES] for w in row if w) for row in zip(*(c.tolist() for c in columns))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary())], names=["lang", "gram"])

    # a bounded sample: at most a few dozen marks a range
    found = sorted((r["lang"].encode(), tuple(bytes(r["gram"]).split(b"\n"))) for r in sample.mapInArrow(marks, "lang string, gram binary").toLocalIterator())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def _counted(df: DataFrame, cuts: list[Cut], depth: int, at_least: int) -> DataFrame:
    """A transducer per range, of the n-grams that have the least count; ``n`` are the words its shards counted.

    Stored, as later steps read it twice.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, key, counts, total in _by_language(batches, depth):
            for at, data in _slices(cuts, lang, words, _unpacked(key, depth), counts):
                yield _rows([(lang, at, None, total, data)])
                total = 0  # the words of a shard count once

    def unite(group: pa.Table) -> pa.Table:
        parts = [Automaton.from_bytes(d.as_py()) for d in group["data"]]
        words, columns, counts = union(parts, at_least=at_least)
        data = Automaton.build(words, columns, counts).to_bytes()
        return pa.Table.from_batches([_rows([(group["lang"][0].as_py(), group["range"][0].as_py(), None, sum(group["n"].to_pylist()), data)])])

    return store(df.mapInArrow(shards, _ROWS).groupBy("lang", "range").applyInArrow(unite, _ROWS), "phrase-counts")


def _head(columns: Columns, k: int) -> Columns:
    return [c if i < k else np.zeros_like(c) for i, c in enumerate(columns)]


def _rest(columns: Columns, k: int) -> Columns:
    return [*columns[k:], *[np.zeros_like(columns[0])] * k]


def _size(columns: Columns) -> np.ndarray:
    return sum((c > 0).astype(np.int64) for c in columns)


def _parts(columns: Columns, counts: np.ndarray) -> tuple[Columns, np.ndarray]:
    """Sorted distinct first parts and rests of all phrases, each with 1 more than the largest count
    of a phrase that is one word longer."""
    size, found, weight = _size(columns), [], []
    for k in range(1, len(columns)):
        longer = size > k
        phrase = [c[longer] for c in columns]
        found += [_head(phrase, k), _rest(phrase, k)]
        above = np.where(size == k + 1, counts, 0)[longer]
        weight += [above + 1, (counts[longer] if k == 1 else 0 * above) + 1]
    columns, weight = [np.concatenate(c) for c in zip(*found)], np.concatenate(weight)
    order, starts = sort_order(columns)
    return [c[order[starts]] for c in columns], np.maximum.reduceat(weight[order], starts) if len(starts) else weight


def _ask(cuts: list[Cut], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts that the candidates of each range need, each piece for the range it falls in."""
    for batch in batches:
        for lang, at, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "range", "data"))):
            words, columns, counts = union([Automaton.from_bytes(data)])
            asked, weight = _parts(columns, counts)
            for to, piece in _slices(cuts, lang, words, asked, weight):
                yield _rows([(lang, to, at, 0, piece)])


def _split(group: pa.Table) -> tuple[str, int, Automaton, list[tuple[int, Automaton]]]:
    """Language and range of a group, its transducer, and what others sent."""
    lang, at = group["lang"][0].as_py(), group["range"][0].as_py()
    rows = [(a, Automaton.from_bytes(d)) for a, d in zip(group["asker"].to_pylist(), group["data"].to_pylist())]
    (own,) = [d for a, d in rows if a is None]  # parts of counted phrases are counted
    return lang, at, own, [(a, d) for a, d in rows if a is not None]


_ABOVE = -1


def _answer(group: pa.Table) -> pa.Table:
    """Composes what was asked of a range with its transducer.

    Back go the counts of the parts to each asker and, from asker ``_ABOVE``, to the
    range itself 1 more than the largest count of a phrase one word longer.
    """
    lang, at, own, asked = _split(group)
    words, columns, counts = union([own])
    number = {w: i for i, w in enumerate(words, 1)}
    out, above = [], np.zeros(len(counts), np.int64)
    for asker, automaton in asked:
        names, found, weight = union([automaton])
        here = numbers_in(names, number)
        mine = [here[c] for c in found]
        n = look_up(mine, columns, counts)
        above = np.maximum(above, look_up(columns, mine, weight))
        out.append((lang, asker, at, 0, Automaton.build(names, found, n).to_bytes()))
    met = above > 0
    out.append((lang, at, _ABOVE, 0, Automaton.build(words, [c[met] for c in columns], above[met]).to_bytes()))
    return pa.Table.from_batches([_rows(out)])


def _floored(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """floor(SCALE a a / (left right)), exact also where products pass 64 bits."""
    wide = (a.astype(float) ** 2 * SCALE > 2.0**62) | (left.astype(float) * right > 2.0**62)
    out = np.zeros(len(a), np.int64)
    out[~wide] = SCALE * a[~wide] ** 2 // (left[~wide] * right[~wide])
    out[wide] = [SCALE * x * x // (y * z) for x, y, z in zip(a[wide].tolist(), left[wide].tolist(), right[wide].tolist())]
    return out


_SCORED = "lang string, phrase string, a long, l long, r long, score long"


def _score(cover: int, top: int, group: pa.Table) -> pa.Table:
    """The best phrases of a range, from its transducer and the answers it got."""
    lang, _, own, sent = _split(group)
    words, columns, counts = union([own])
    number = {w: i for i, w in enumerate(words, 1)}

    def taken(parts: list[Automaton]) -> tuple[Columns, np.ndarray]:
        if not parts:
            return [c[:0] for c in columns], counts[:0]
        names, found, n = union(parts)
        here = numbers_in(names, number)
        return [here[c] for c in found], n

    parts = taken([d for a, d in sent if a != _ABOVE])
    above = look_up(columns, *taken([d for a, d in sent if a == _ABOVE])) - 1
    size = _size(columns)
    kept = (size > 1) & ~((above > 0) & (100 * above.astype(float) >= cover * counts.astype(float)))
    columns, a, size = [c[kept] for c in columns], counts[kept], size[kept]
    best = np.full(len(a), np.iinfo(np.int64).max)
    left, right = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(1, len(columns)):
        longer = np.flatnonzero(size > k)
        phrase = [c[longer] for c in columns]
        x, y = look_up(_head(phrase, k), *parts), look_up(_rest(phrase, k), *parts)
        score = _floored(a[longer], x, y)
        lower = score < best[longer]
        rows = longer[lower]
        best[rows], left[rows], right[rows] = score[lower], x[lower], y[lower]
    order = np.lexsort((-a, -best))
    if len(order) > top:  # phrases level with the last one are all kept for now
        last = order[top - 1]
        order = order[: int(np.flatnonzero((best[order] == best[last]) & (a[order] == a[last]))[-1]) + 1]
    names = [b"", *words]
    phrases = [b" ".join(names[w] for w in row if w) for row in zip(*(c[order].tolist() for c in columns))]
    found = sorted(zip((-best[order]).tolist(), (-a[order]).tolist(), phrases, left[order].tolist(), right[order].tolist()))[:top]
    rows = [(lang, p.decode(), -n, x, y, -s) for s, n, p, x, y in found]
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), *((c, pa.int64()) for c in ("a", "l", "r", "score"))])
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(6)], schema=schema)


#: Groups in which the best phrases of ranges are merged before the last merge.
MERGE_GROUPS = 16


def collocations(
    docs: DataFrame, text_col: str, lang_col: str, depth: int = MAX_WORDS, at_least: int = MIN_COUNT, cover: int = COVER, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``depth`` words.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of the cut that scores lowest,
    ``n`` the words of the language.
    """
    text, lang = F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string")
    df = docs.select(text.alias("text"), F.coalesce(lang, F.lit("und")).alias("lang"))
    cuts = _range_ends(df, depth)
    counted = _counted(df, cuts, depth, at_least)
    asked = counted.mapInArrow(lambda batches: _ask(cuts, batches), _ROWS)
    answers = counted.unionByName(asked).groupBy("lang", "range").applyInArrow(_answer, _ROWS)
    known = counted.unionByName(answers).groupBy("lang", "range")
    scored = known.applyInArrow(lambda group: _score(cover, top, group), _SCORED)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    grouped = scored.withColumn("g", F.pmod(F.xxhash64("phrase"), F.lit(MERGE_GROUPS)))
    some = Window.partitionBy("lang", "g").orderBy(*order)
    merged = grouped.withColumn("i", F.row_number().over(some)).filter(F.col("i") <= top).drop("g", "i")
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    words = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    out = ranked.join(words, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_PIECES = r"string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')"

ORACLE_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest({_PIECES}) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT lang, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS g, a FROM c WHERE k > 2),
h AS (SELECT lang, g, max(a) AS above FROM s GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN h USING (lang, g) WHERE h.above IS NULL OR 100 * h.above < {COVER} * a),
cut AS (SELECT *, unnest(range(1, k)) AS i FROM k),
sc AS (SELECT cut.lang, cut.g, a, i, x.f AS l, y.f AS r, ({SCALE} * a::HUGEINT * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.g = array_to_string(w[1:i], ' ')
  JOIN f y ON y.lang = cut.lang AND y.g = array_to_string(w[i + 1:cut.k], ' ')),
b AS (SELECT lang, g AS phrase, any_value(a) AS a, arg_min({{'l': l, 'r': r, 'score': score}}, score * 4 + i) AS m FROM sc GROUP BY ALL)
SELECT lang, rank, phrase, a, m.l AS l, m.r AS r, n, m.score AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY m.score DESC, a DESC, phrase) AS rank FROM b) JOIN n USING (lang) WHERE rank <= {TOP}
"""
