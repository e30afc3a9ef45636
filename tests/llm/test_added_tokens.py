"""Ids are those of the plain library call, also where a text names an added token."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from mailrisk.llm.tokens import worker_encoder


def test_names_of_added_tokens_are_their_ids(tokenizer):
    plain, encode, rnd = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), worker_encoder(tokenizer), random.Random(7)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", "a b", " ", "\n\n", "it's", "日本", "é 12"]
    texts = ["a b<|endoftext|>c"] + ["".join(rnd.choices(parts, k=rnd.randrange(8))) for _ in range(2000)]
    for t in texts:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t), dtype=encode.dtype).tolist() == ids, repr(t)
    assert 50256 in plain.encode(texts[0], add_special_tokens=False).ids
