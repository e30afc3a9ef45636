"""Class probabilities to labels and scores; prompts and answers of text models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrisk.functions.text import ColumnLike, _col, strip
from mailrisk.functions.vectors import let, total

# Prompt wording and answer marker (fixed values of the prompted model).
ANSWER_MARK = "<<ANSWER>>:"
PROMPT = "Classify as phishing (TRUE) or not (FALSE):\n%s\n" + ANSWER_MARK

# Class order of the four-class model (fixed values); odd positions are phishing.
FOUR_CLASSES = ["legitimate_email", "phishing_url", "legitimate_url", "phishing_url_alt"]


def softmax(logits: ColumnLike) -> Column:
    x = F.transform(_col(logits), lambda v: v.cast("double"))
    exps = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(exps, lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t)))


def argmax(probs: ColumnLike) -> Column:
    """Zero-based position of the first maximum."""
    p = _col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def round6(c: ColumnLike) -> Column:
    return F.round(_col(c), 6)


def percent(part: ColumnLike, whole: ColumnLike) -> Column:
    return F.lit(100.0) * _col(part) / _col(whole)


def _directed(is_phish: Column, confidence: Column) -> Column:
    return round6(F.when(is_phish, confidence).otherwise(F.lit(1.0) - confidence))


def label_named(name: ColumnLike) -> Column:
    return F.when(_col(name) == "phishing", 1).otherwise(0)


def score_named(name: ColumnLike, score: ColumnLike) -> Column:
    return _directed(label_named(name) == 1, _col(score).cast("double"))


def label_two_class(probs: ColumnLike) -> Column:
    return argmax(probs)


def score_two_class(probs: ColumnLike) -> Column:
    return _directed(argmax(probs) == 1, F.array_max(_col(probs)))


def label_four_class(probs: ColumnLike) -> Column:
    return argmax(probs) % 2


def score_four_class(probs: ColumnLike) -> Column:
    """Confidence of the best class alone, not the sum over the phishing classes."""
    return _directed(label_four_class(probs) == 1, F.array_max(_col(probs)))


def score_column_name(label_column: str) -> str:
    """``<model>_label`` -> ``<model>_score``."""
    return label_column.rsplit("_", 1)[0] + "_score"


def build_prompt(text: ColumnLike) -> Column:
    return F.format_string(PROMPT, _col(text))


def extract_answer(output: ColumnLike, mark: str = ANSWER_MARK) -> Column:
    """Stripped text after the last answer mark."""
    return strip(F.substring_index(_col(output), mark, -1))


def extract_first_answer(output: ColumnLike, mark: str = ANSWER_MARK) -> Column:
    """Stripped text between the first answer mark and the next; null without a mark."""
    return strip(F.get(F.split(_col(output), r"\Q" + mark + r"\E"), F.lit(1)))


def parse_boolean(answer: ColumnLike) -> Column:
    """1 when the first true/false word in the answer says true, else 0."""
    first = F.lower(F.regexp_extract(F.coalesce(_col(answer), F.lit("")), r"(?i)\b(true|false)", 1))
    return F.when(first == "true", 1).otherwise(0)


def majority_vote(response: ColumnLike) -> Column:
    """1 when at least three of the first five TRUE/FALSE marks are TRUE."""
    packed = F.upper(F.replace(F.coalesce(_col(response), F.lit("")), F.lit(" "), F.lit("")))
    votes = F.slice(F.regexp_extract_all(packed, F.lit("(TRUE|FALSE)"), 1), 1, 5)
    return F.when(F.size(F.filter(votes, lambda v: v == "TRUE")) >= 3, 1).otherwise(0)


def answer_shares(answers: ColumnLike) -> Column:
    """[share of no, share of yes] among a generator's outputs for one prompt; no output at all is a no."""
    flags = F.transform(_col(answers), lambda a: parse_boolean(extract_answer(a)))
    yes = F.coalesce(F.size(F.filter(flags, lambda f: f == 1)) / F.nullif(F.size(flags), F.lit(0)), F.lit(0.0))
    return F.array(F.lit(1.0) - yes, yes)
