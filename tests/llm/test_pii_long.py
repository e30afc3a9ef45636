"""The best path over a long chain, found block by block, is that of the plain recursion."""

import random
import time

import numpy as np
import pytest

from mailrisk.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_table())


@pytest.mark.parametrize("block, warm", [(512, 64), (16, 4), (7, 0), (1, 0), (4000, 64)])
def test_blocks_change_nothing(field, block, warm):
    rng = np.random.default_rng(block)
    for length in (1, 2, 511, 512, 513, 3000):
        row = rng.integers(0, len(field.shapes), length)
        assert (pii.long_path(field, row, block, warm) == pii.viterbi(field, row[None])[0]).all()


def test_scores_that_do_not_settle_are_carried_over(field):
    # tags that stay what they were: only the first token decides, however far back it is
    t = len(pii.TAGS)
    stay = pii.ShapeField({"a": 0, "b": 1}, np.zeros((5, 2, t)), np.where(np.eye(t) > 0, 0.0, -100.0), np.zeros(t))
    stay.emit[2, 1, 3] = 1.0  # the shape b speaks for tag 3
    row = np.zeros(900, dtype=np.int64)
    row[0] = 1
    got = pii.long_path(stay, row, 64, 8)
    assert (got == pii.viterbi(stay, row[None])[0]).all() and (got == 3).all()


def test_a_long_text_costs_what_short_ones_do(field):
    rnd = random.Random(3)
    table = [text for text, _ in pii.labelled_table(9)]
    texts = [" ".join(rnd.choices(table, k=12)) for _ in range(1500)]
    pii.field_spans(texts[:50], field)
    start = time.perf_counter()
    apart = pii.field_spans(texts, field)
    short = time.perf_counter() - start
    start = time.perf_counter()
    whole = pii.field_spans([" ".join(texts)], field)[0]
    long = time.perf_counter() - start
    assert long < 3 * short
    assert abs(len(whole) - sum(map(len, apart))) < 0.05 * len(whole)
