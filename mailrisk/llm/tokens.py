"""Token ids of whole texts by a public byte-level tokenizer."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Pieces a worker remembers; the others are encoded each time.
CACHE_PIECES = 400_000

# The piece rule that byte-level tokenizers of this kind state in
# their files, written out for characters whose class no Unicode version
# changed (Latin, Latin-1 and Latin Extended-A, ASCII and general punctuation).
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = " \t\n\r"
_PIECE = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+"
    f"| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_PLAIN = re.compile("[\t\n\r -~¡-ſ‐-‧‰-⁞]*")


def _byte_letters() -> dict[int, str]:
    """The letter a byte-level tokenizer spells each byte with, as the library has it."""
    from tokenizers.pre_tokenizers import ByteLevel

    spell = ByteLevel(add_prefix_space=False, use_regex=False)
    letters: dict[int, str] = {}
    for c in map(chr, [*range(0x180), *range(0x2000, 0x2060)]):  # all bytes of what _PLAIN lets through
        ((spelled, _),) = spell.pre_tokenize_str(c)
        letters.update(zip(c.encode(), spelled))
    return letters


class _Pieces(dict):
    """Ids of pieces by the tokenizer's model; the first CACHE_PIECES short ones are remembered."""

    def __init__(self, model, dtype: str):
        super().__init__()
        self._model, self._letters = model, _byte_letters()
        self._kind = "H" if dtype == "<u2" else "I"

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self._letters)
        found = array(self._kind, [t.id for t in self._model.tokenize(spelled)]).tobytes()
        if len(self) < CACHE_PIECES and len(piece) < 64:
            self[piece] = found
        return found


class Encoder:
    """Ids of a text as little-endian bytes, two or four a token.

    Texts of common characters are cut into the tokenizer's own pieces, and the
    library's model gives the ids of a piece, most pieces once.  Any other text, one
    that holds the name of an added token, or any other kind of tokenizer, is encoded
    by the library as a whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        self._added = [t["content"] for t in spec.get("added_tokens") or []]  # their names in a text are one id each
        cut = spec.get("pre_tokenizer") or {}
        self._by_piece = (
            not spec.get("normalizer")
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space", True)
        )
        self.dtype = "<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self._pieces = _Pieces(self._tokenizer.model, self.dtype) if self._by_piece else {}

    def _encode(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._by_piece and _PLAIN.fullmatch(text) and not any(name in text for name in self._added):
            return b"".join(map(self._pieces.__getitem__, _PIECE.findall(text)))
        return self._encode(text)


_encoders: dict[int, Encoder] = {}


def worker_encoder(definition: Broadcast) -> Encoder:
    """The encoder of this Python worker, kept between its tasks."""
    key = hash(definition.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition.value)
    return _encoders[key]


def share_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file (a few MB) for all executors; they need no copy of their own."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())
