"""Phrases against plain counting, on few and on many ranges."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailrisk.llm import collocation as C
from mailrisk.llm.automaton import Automaton, cut_place, look_up, numbers_in, union

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_hand(docs, depth=3, at_least=10, cover=50, top=2000):
    words, grams = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(_LOWER)):
            found = [w for w in re.split(r"[ \t]+", piece) if w]
            words[lang] += len(found)
            for k in range(1, depth + 1):
                for i in range(len(found) - k + 1):
                    grams[lang, tuple(found[i : i + k])] += 1
    grams = {g: n for g, n in grams.items() if n >= at_least}
    above = Counter()
    for (lang, g), n in grams.items():
        for k in range(1, len(g)):
            for i in range(len(g) - k + 1):
                above[lang, g[i : i + k]] = max(above[lang, g[i : i + k]], n)
    rows = []
    for (lang, g), a in grams.items():
        if len(g) > 1 and not (above[lang, g] and 100 * above[lang, g] >= cover * a):
            cuts = [(10**6 * a * a // (grams[lang, g[:k]] * grams[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            rows.append((lang, -score, -a, " ".join(g).encode(), grams[lang, g[:k]], grams[lang, g[k:]]))
    out, seen = [], Counter()
    for lang, score, a, g, left, right in sorted(rows):
        seen[lang] += 1
        if seen[lang] <= top:
            out.append((lang, seen[lang], g.decode(), -a, left, right, words[lang], -score))
    return out


def rows(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [8 << 20, 20_000])
def test_table_against_plain_counts(spark, sf_dir, monkeypatch, size):
    monkeypatch.setattr(C, "RANGE_BYTES", size)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    if size < 1 << 20:
        assert len(C._range_ends(docs.selectExpr("text", "lang"), 3)) > 5
    assert rows(C.collocations(docs, "text", "lang")) == by_hand([(r["text"], r["lang"]) for r in docs.collect()])


def test_odd_rows(spark, odd_docs):
    docs = [(r["text"], r["lang"]) for r in odd_docs.collect()]
    want = by_hand(docs, at_least=1, top=7)
    assert rows(C.collocations(odd_docs, "text", "lang", at_least=1, top=7)) == want and {w[0] for w in want} == {"en", "und"}
    assert C.collocations(odd_docs.limit(0), "text", "lang").count() == 0


def test_und_joins_null_ties_and_control_characters(spark):
    texts = [("b\x01 a, b c, A b.", None), ("a b, a\x01 c", "und"), ("a b", ""), ("", "x"), (None, "und")] * 2
    df = spark.createDataFrame(texts, "text string, lang string")
    assert rows(C.collocations(df, "text", "lang", at_least=2)) == by_hand(texts, at_least=2)


def test_scores_beyond_64_bits():
    a, left, right = np.array([10**13, 5]), np.array([10**14, 7]), np.array([10**15 + 1, 6])
    assert C._floored(a, left, right).tolist() == [10**6 * 10**26 // (10**14 * (10**15 + 1)), 10**6 * 25 // 42]


def test_a_shard_is_counted_in_steps(monkeypatch):
    monkeypatch.setattr(C, "SHARD_WORDS", 7)
    shard, total, counts = C._Shard(), 0, Counter()
    shard.add([b"a b c d e f g a b c d e f g h a b c", b"a b"])
    for words, key, n, found in shard.take(3):
        total += found
        for row, x in zip(zip(*C._unpacked(key, 3)), n):
            counts[tuple(words[w - 1] for w in row if w)] += int(x)
    assert total == 20 and counts[b"a", b"b"] == 4 and counts[b"a", b"b", b"c"] == 3 and counts[b"c", b"a"] == 0


SEQUENCES = st.dictionaries(st.lists(st.sampled_from([b"a", b"b", b"ab", b"z"]), min_size=1, max_size=3).map(tuple), st.integers(1, 3), min_size=1)


def automaton(found):
    words = sorted({w for g in found for w in g})
    number = {w: i for i, w in enumerate(words, 1)}
    grams = sorted(found)
    columns = [np.array([number[g[k]] if k < len(g) else 0 for g in grams]) for k in range(3)]
    return Automaton.build(words, columns, np.array([found[g] for g in grams])), words, columns


def listed(words, columns, counts):
    return {tuple(words[w - 1] for w in row if w): int(n) for row, n in zip(zip(*columns), counts)}


@settings(max_examples=200, deadline=None)
@given(SEQUENCES, SEQUENCES, st.lists(st.sampled_from([b"a", b"aa", b"b", b"y"]), min_size=1, max_size=3))
def test_automata(a, b, cut):
    x, words, columns = automaton(a)
    back = Automaton.from_bytes(x.to_bytes())
    assert listed(back.words, *back.sequences()) == a
    both = Counter(a)
    both.update(b)
    y = automaton(b)[0]
    assert listed(*union([back, y])) == both
    assert listed(*union([x, y], at_least=3)) == {g: n for g, n in both.items() if n >= 3}
    names, found, n = union([y])
    here = numbers_in(names, {w: i for i, w in enumerate(words, 1)})
    got = look_up([here[c] for c in found], columns, np.array([a[g] for g in sorted(a)]))
    assert {g: v for g, v in listed(names, found, got).items()} == {g: a.get(g, 0) for g in b}
    assert cut_place(tuple(cut), words, columns) == sum(g < tuple(cut) for g in a)


def test_equal_states_are_one():
    many = {(p, q, r): 2 for p in (b"a", b"b", b"c") for q in (b"d", b"e") for r in (b"f", b"g")}
    found = automaton(many)[0]
    assert len(found.starts) - 2 == 3  # one state after two words, one after one, the root
