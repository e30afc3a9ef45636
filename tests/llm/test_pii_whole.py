"""The field sees every token of a text."""

import random

import numpy as np
import pytest

from mailrisk.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_table())


def test_addresses_without_digit_or_written_dot_are_found(field):
    cases = {
        "write to john (at) example.com today": "john (at) example.com", "mail anna [at] firma.org": "anna [at] firma.org",
        "please mail anna at firma dot de today": "anna at firma dot de", "contact anna (at) firma (dot) fr": "anna (at) firma (dot) fr",
    }
    for text, value in cases.items():
        ((_, every),) = pii.all_spans([text], field)
        assert [text[a:b] for a, b in every["email"]] == [value]
    for text in ("we met at noon. then we left", "look at this. It is a dot", "he was (at home) alone. Then", "at the end, at last. at it"):
        assert not any(pii.all_spans([text], field)[0][1].values())


def test_spans_are_those_of_viterbi_over_all_tokens(field):
    rnd, other = random.Random(3), len(field.shapes)
    wide = pii.ShapeField(field.shapes, np.pad(field.emit, ((0, 0), (0, 1), (0, 0))), field.move, field.first)
    quiet = ["quiet", "words,", "and.", "at", "a_b", "x1y2", "(so)", "dot"]
    table = pii.labelled_table(5)
    texts = [" ".join(p for t, _ in rnd.sample(table, 4) for p in (t, *rnd.choices(quiet, k=rnd.choice([0, 3, 12, 60])))) for _ in range(60)]
    texts += [" ".join(rnd.choices(["quiet", "words", "dot"], k=40)) for _ in range(5)]
    for text, (base, every) in zip(texts, pii.all_spans(texts, field)):
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        row = np.array([[field.shapes.get(pii.shape(text[a:b]), other) for a, b in tokens]])
        held = [s for v in base.values() for s in v]
        want = {k: list(v) for k, v in base.items()}
        for kind, a, b in pii._spans_of(tokens, pii.viterbi(wide, row)[0]):
            if pii._plausible(kind, text[a:b]) and not any(x < b and a < y for x, y in held):
                want[kind].append((a, b))
        assert every == {k: sorted(v) for k, v in want.items()}
