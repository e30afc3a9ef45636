"""Words of whole batches of texts, as numbers: one table look-up per byte, one split per run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Stands between texts and between pieces; no byte of UTF-8 has this value.
BREAK = b"\xff"
RUN_BYTES = 2 << 20


def byte_table(word: Callable[[int], bool], split: Callable[[int], bool] = lambda b: False) -> bytes:
    """What each byte becomes: A-Z lower case, bytes that ``split`` a new line, others not in a ``word`` a blank."""
    out = bytearray(range(256))
    for b in range(128):
        if split(b):
            out[b] = 0x0A
        elif not word(b):
            out[b] = 0x20
        elif 0x41 <= b <= 0x5A:
            out[b] = b + 32
    return bytes(out)


def word_runs(texts: list[bytes], table: bytes, limit: int = RUN_BYTES) -> Iterator[list[bytes]]:
    """Words of texts in runs of bounded size, however long a text is.

    A ``BREAK`` stands between two texts and for every new line that the table makes.
    """
    joined = b"\n".join([t.translate(table) for t in texts]).replace(b"\n", b" " + BREAK + b" ")
    start = 0
    while start < len(joined):
        end = joined.find(b" ", start + limit)
        end = len(joined) if end < 0 else end
        yield joined[start:end].split()
        start = end


def numbered(texts: list[bytes], table: bytes, number: Callable[[bytes], int]) -> np.ndarray:
    """Numbers of the words of texts in order, with that of ``BREAK`` where one stands."""
    runs = [np.fromiter(map(number, run), np.int64, len(run)) for run in word_runs(texts, table)]
    return np.concatenate(runs) if runs else np.zeros(0, np.int64)


def text_chunks(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts as bytes) of groups of texts of about ``limit`` bytes; null is empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts.cast(pa.large_binary())):
        data = text.as_py() or b""
        if held and size + len(data) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield first, held
