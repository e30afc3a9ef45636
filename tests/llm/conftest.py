import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def tokenizer(spark):
    import public_tokenizers

    from mailrisk.llm.tokens import share_tokenizer

    return share_tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="session")
def plain_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


#: Texts every text operator must take: null, empty, white space, one word, marks, letters of many kinds, very long.
ODD_TEXTS = [None, "", "   \n\t", "one", "!!!", "Ünïcödé ßtraße", "日本語 テキスト 🙂", "a\x00b\x1cc", "x " * 30_000, "y" * 60_000, "same text again", "same text again"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with nulls in every column, a repeated id, and extra columns named like internal ones."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else "s", i) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "a row without id", "en", "s", None), (5, ODD_TEXTS[5], "en", None, 5), (5, "another text of id five", "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    names = ["score", "fp", "u", "v", "node", "root", "size", "copies", "piece", "_text", "_key", "_size", "quality"]
    return df.selectExpr("*", *[f"'clash' AS `{n}`" for n in names])
