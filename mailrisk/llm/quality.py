"""Text quality by a generalised additive model with pairwise interactions.

Shape functions are look-up tables over feature bins, learned by cyclic
boosting of shallow trees; a score is the sigmoid of a sum of table entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.common import bounded_sample, crc_of_id

#: Labelled documents the model learns from, at most.
SAMPLE = 8000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 60
RATE = 0.1
LEAVES = 3
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "mean_word", "long_words", "upper", "digits", "marks", "odd_marks", "pipes", "line_rate",
    "non_ascii", "distinct_words", "top_word", "ends_in_mark", "capital_words", "repeated_lines", "common_words",
)

_KIND = np.zeros((6, 256))  # letters, capitals, digits, marks, sentence marks, high bytes
_KIND[0, list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[1, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[2, list(b"0123456789")] = 1
_KIND[3, [c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_KIND[4, list(b".,;:'\"-()?")] = 1
_KIND[5, 128:] = 1
_MARKS = tuple(bytes([c]) for c in b"!#$%&*+/<=>@\\^_`{|}~")


def features(text: str | None) -> np.ndarray:
    """Measures of a whole text in the order of ``FEATURES``; all zero without words."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return np.zeros(len(FEATURES))
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    letters, capitals, digits, marks, sentence, high = _KIND @ counts
    size, n = len(data), len(words)
    seen = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    solid = size - counts[[9, 10, 11, 12, 13, 32]].sum()
    tail = sum(c for w, c in seen.items() if w.endswith(_MARKS))
    shout = sum(c for w, c in seen.items() if w.isupper())
    long = sum(c for w, c in seen.items() if len(w) > 15)
    short = sum(c for w, c in seen.items() if len(w) < 4)
    return np.array(
        [
            np.log1p(size), solid / n, long / n, capitals / max(1.0, letters), digits / size, marks / size,
            (marks - sentence) / size, counts[124] / n, len(lines) / n, high / size, len(seen) / n,
            max(seen.values()) / n, tail / n, shout / n, 1 - len(set(lines)) / len(lines), short / n,
        ]
    )


@dataclass
class AdditiveModel:
    """Bin edges and tables: one per feature, one per pair of features."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of rows of features."""
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            a = np.searchsorted(self.pair_edges[i], x[:, i], side="right")
            b = np.searchsorted(self.pair_edges[j], x[:, j], side="right")
            total += table[a, b]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradient sums g and weights h."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Step of a shallow tree over ordered bins: best-first cuts, a Newton step per leaf."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(cuts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best four-leaf tree over two bin axes: one cut, then one in each half along the other axis."""
    best = (-1.0, np.zeros_like(g))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        _, at = _best_cut(gg.sum(axis=1), hh.sum(axis=1))
        step, gain = np.zeros_like(gg), -(gg.sum() ** 2) / (hh.sum() + 1)
        for rows in (slice(0, at), slice(at, None)):
            a, b = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
            _, cut = _best_cut(a, b)
            for cols in (slice(0, cut), slice(cut, None)):
                s, w = a[cols].sum(), b[cols].sum()
                step[rows, cols] = s / (w + 1)
                gain += s * s / (w + 1)
        if gain > best[0]:
            best = (float(gain), step.T if turned else step)
    return best


def fit_tables(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost the features in turn; then, on what is left, the pairs that explain most."""
    n, k = x.shape
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    base = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, j], BINS) if n else np.zeros(0) for j in range(k)]
    pair_edges = [_edges(x[:, j], PAIR_BINS) if n else np.zeros(0) for j in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = AdditiveModel(base, edges, tables, [], pair_edges, [])
    if not n:
        return model
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]
    total = np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(k):
            g, h = slopes()
            size = len(tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
            tables[j] += step
            total += step[bins[j]]
    g, h = slopes()

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)
        return np.bincount(coarse[i] * shape[1] + coarse[j], v, shape[0] * shape[1]).reshape(shape)

    gains = {(i, j): _pair_tree(grid(i, j, g), grid(i, j, h))[0] for i in range(k) for j in range(i)}
    model.pairs = sorted(sorted(gains), key=gains.get, reverse=True)[:PAIRS]
    model.pair_tables = [np.zeros(grid(i, j, g).shape) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[1]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> AdditiveModel:
    """The model learned from at most ``sample`` labelled documents, picked by a hash of the id.

    ``labels`` are the rows learning may use; rows with a null id or label, or
    with a label other than 0 and 1, are not.  Without any, every score is 0.5.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).alias("_label"))
    picked = bounded_sample(usable, id_col, sample)  # bounded, so it can be broadcast
    texts = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(picked), id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).tolist() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])

    # repeated ids would lift the bound: at most twice the sample is taken
    found = texts.select(F.col("_label").cast("int").alias("_label"), "_text").mapInArrow(run, "label int, x array<double>")
    rows = found.limit(2 * sample).toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    order = np.lexsort([*x.T, rows["label"].to_numpy()])  # the same model whatever the order of the rows
    return fit_tables(x[order], rows["label"].to_numpy(dtype=np.float64)[order])


def score(df: DataFrame, text_col: str, model: AdditiveModel, out: str = "score") -> DataFrame:
    """``df`` with the score of every whole text; null and empty texts have that of all-zero features.

    Row by row, whatever the length; equal texts have equal scores, repeated rows
    come back as often as given, an empty table gives none.  A column of ``df`` named
    ``out`` is replaced.
    """
    df = df.drop(out)
    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            x = np.empty((len(texts), len(FEATURES)))
            for i, t in enumerate(texts):
                x[i] = features(t.as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*names, out])

    return df.mapInArrow(run, f"{fields}, `{out}` double")


def held_out(id_col: str) -> Column:
    """Rows no label is learned from."""
    return F.coalesce(crc_of_id(id_col) % 5 == 0, F.lit(False))
