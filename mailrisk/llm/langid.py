"""Language of whole texts by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.common import crc_of_id

#: Labelled documents the network learns from, at most.
SAMPLE = 4000
#: Windows of a labelled document it learns from, at most, spread over the text.
SAMPLE_WINDOWS = 4
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
EPOCHS = 8
BATCH = 64
SEED = 7
UNKNOWN = "und"

_STEP = WINDOW - max(WIDTHS) + 1
_GROUP = 128  # windows scored together: their work fits the cache


def windows(data: bytes) -> np.ndarray:
    """All bytes in rows of ``WINDOW``, overlapping so that no filter position is lost; zero padded."""
    n = max(1, -(-(len(data) - WINDOW) // _STEP) + 1)
    padded = np.zeros((n - 1) * _STEP + WINDOW, dtype=np.uint8)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::_STEP]


@dataclass
class ByteNetwork:
    """Embedding, filters of several widths, max pooling over the window, softmax."""

    classes: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # per width: width x EMBEDDING x FILTERS
    bias: np.ndarray  # all filters
    out: np.ndarray  # all filters x classes
    out_bias: np.ndarray

    def tables(self) -> np.ndarray:
        """What a byte adds to each filter, by its place in the filter: max width x 256 x all filters."""
        table = np.zeros((max(WIDTHS), 256, self.bias.size), dtype=np.float32)
        for k, f in enumerate(self.filters):
            for place in range(f.shape[0]):
                table[place, :, k * FILTERS : (k + 1) * FILTERS] = self.embedding @ f[place]
        table[0] += self.bias
        return table

    def scorer(self):
        """Windows to class probabilities; pairs of neighbouring bytes are looked up together."""
        t = self.tables()
        first = (t[0][:, None, :] + t[1][None, :, :]).reshape(1 << 16, -1)
        second = (t[2][:, None, :] + t[3][None, :, :]).reshape(1 << 16, -1)

        def score(w: np.ndarray) -> np.ndarray:
            pair = w[:, :-1].astype(np.int32) << 8 | w[:, 1:]
            pooled = np.empty((len(w), first.shape[1]), dtype=np.float32)
            for at in range(0, len(w), _GROUP):
                p = pair[at : at + _GROUP]
                conv = first.take(p[:, :_STEP], axis=0)
                conv += second.take(p[:, 2 : 2 + _STEP], axis=0)
                pooled[at : at + _GROUP] = conv.max(axis=1)
            return _softmax(np.maximum(pooled, 0) @ self.out + self.out_bias)

        return score


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: list[str], epochs: int = EPOCHS, seed: int = SEED) -> ByteNetwork:
    """Fit by Adam on windows ``x`` (rows of bytes) and class numbers ``y``."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    net = ByteNetwork(
        classes,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(total, dtype=np.float32),
        rng.normal(0, 1 / np.sqrt(total), (total, len(classes))).astype(np.float32),
        np.zeros(len(classes), dtype=np.float32),
    )
    weights = [net.embedding, *net.filters, net.bias, net.out, net.out_bias]
    means, squares, step = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            step += 1
            for p, g, m, s in zip(weights, _gradients(net, x[rows], y[rows]), means, squares):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: ByteNetwork, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n, rows = len(x), np.arange(len(x))
    e = net.embedding[x]  # n x WINDOW x EMBEDDING
    pooled, best = [], []
    for k, f in enumerate(net.filters):
        conv = sum(e[:, j : j + _STEP] @ f[j] for j in range(f.shape[0]))
        at = conv.argmax(axis=1)
        best.append(at)
        pooled.append(np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0])
    raw = np.concatenate(pooled, axis=1) + net.bias
    hidden = np.maximum(raw, 0)
    d_logits = _softmax(hidden @ net.out + net.out_bias)
    d_logits[rows, y] -= 1
    d_logits /= n
    d_raw = (d_logits @ net.out.T) * (raw > 0)
    d_embedding = np.zeros_like(net.embedding)
    d_filters = []
    for k, f in enumerate(net.filters):
        d = d_raw[:, k * FILTERS : (k + 1) * FILTERS]
        d_f = np.empty_like(f)
        for j in range(f.shape[0]):
            at = best[k] + j  # n x FILTERS: the byte under place j of each filter
            seen = e[rows[:, None], at]  # n x FILTERS x EMBEDDING
            d_f[j] = np.einsum("nf,nfe->ef", d, seen)
            np.add.at(d_embedding, x[rows[:, None], at], d[:, :, None] * f[j].T[None])
        d_filters.append(d_f)
    return [d_embedding, *d_filters, d_raw.sum(axis=0), hidden.T @ d_logits, d_logits.sum(axis=0)]


def fit(df: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> ByteNetwork | None:
    """The network learned from rows with a label and a letter in their text; None if there are none.

    Learns from about ``sample`` documents, the same share of each label's
    rows unless that leaves a label out: each label, however many there are,
    has about ``sample / 20`` of its rows at least, or all.  So the sample, which
    the driver holds, grows by that much a label.
    """
    usable = df.filter(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(id_col, text_col, label_col)
    counts = {r[0]: r[1] for r in usable.groupBy(label_col).count().collect()}
    if not counts:
        return None
    total = sum(counts.values())
    share = {c: min(1.0, max(sample / total, sample / 20 / n)) for c, n in counts.items()}
    place = F.xxhash64(F.col(id_col).cast("string"), F.lit(SEED))
    limit = F.element_at(F.create_map(*[x for c, s in share.items() for x in (F.lit(c), F.lit(_threshold(s)))]), F.col(label_col))
    picked = usable.filter(place <= limit).select(
        F.xxhash64(F.col(id_col).cast("string")).alias("at"), F.col(label_col).alias("label"), F.col(text_col).alias("text")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [_some_windows(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("label"), pa.array(some, pa.binary())], ["at", "label", "windows"])

    # a few windows of each document leave the executors, never a text
    kind = picked.schema["label"].dataType.simpleString()
    learned = picked.mapInArrow(cut, f"at bigint, label {kind}, windows binary")
    rows = learned.orderBy("at", "label", "windows").limit(max(2 * sample, sample + len(counts) * sample // 20)).collect()
    classes = sorted(counts)
    x = [np.frombuffer(r["windows"], dtype=np.uint8).reshape(-1, WINDOW) for r in rows]
    y = np.repeat([classes.index(r["label"]) for r in rows], [len(w) for w in x])
    return train(np.concatenate(x), y, classes)


def _some_windows(text: str) -> bytes:
    """Up to ``SAMPLE_WINDOWS`` windows, evenly over the text, end to end."""
    every = windows(text.encode())
    return every[np.unique(np.linspace(0, len(every) - 1, SAMPLE_WINDOWS).astype(int))].tobytes()


def _threshold(share: float) -> int:
    return min(2**63 - 1, int(-(2**63) + share * 2**64))


def predict(df: DataFrame, id_col: str, text_col: str, net: ByteNetwork | None) -> DataFrame:
    """(id, lang_pred, score): the class with the highest mean probability over all windows of a text.

    Windows weigh as many bytes as they add.  A null text, or one without a
    letter, is ``und`` with score 0, as is every text without a network.  Equal
    probabilities: the class first in order.  Repeated rows come back as often as
    given, an empty table gives none; a very long text is read in groups of
    windows, so memory is bounded by its bytes.  Only the two columns are read.
    """
    plain = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = net.scorer() if net else None
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            letters = batch.column("_letters").to_pylist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            todo = [i for i, has in enumerate(letters) if has and net]
            held, rows = [], []
            for k, i in enumerate(todo):
                w = windows(texts[i].encode())
                held.append(w)
                rows.append(i)
                if sum(map(len, held)) >= _MANY or k == len(todo) - 1:
                    mean = _mean(score, held, [len(texts[j].encode()) for j in rows])
                    for j, p in zip(rows, mean):
                        names[j], scores[j] = net.classes[int(p.argmax())], float(p.max())
                    held, rows = [], []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores)], [id_col, "lang_pred", "score"]
            )

    return plain.mapInArrow(run, f"`{id_col}` {plain.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


_MANY = 2048


def _mean(score, held: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    probs = np.concatenate([score(w) for w in _joined(held)])
    counts = np.array([len(w) for w in held])
    weight = np.full(len(probs), float(_STEP))
    last = np.cumsum(counts) - 1
    weight[last] = np.array(sizes) - (counts - 1) * _STEP
    sums = np.add.reduceat(probs * weight[:, None], last - counts + 1, axis=0)
    return np.clip(sums / np.array(sizes)[:, None], 0, 1)


def _joined(held: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Windows of many texts in groups of bounded size."""
    group, n = [], 0
    for w in held:
        for at in range(0, len(w), _MANY):
            part = w[at : at + _MANY]
            group.append(part)
            n += len(part)
            if n >= _MANY:
                yield np.concatenate(group)
                group, n = [], 0
    if group:
        yield np.concatenate(group)


def held_out(id_col: str):
    """Documents no language is learned from."""
    return F.coalesce(crc_of_id(id_col) % 4 == 2, F.lit(False))
