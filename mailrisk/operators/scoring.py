"""Text classifiers with one contract: a text column in, label 0/1 and score out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailrisk.functions import scores as C
from mailrisk.operators.bayes import features, fit_bayes, words

# Adds an array of class probabilities under the given name.
Probabilities = Callable[[DataFrame, str, str], DataFrame]

_RULES = {
    "two_class": (C.label_two_class, C.score_two_class),
    "four_class": (C.label_four_class, C.score_four_class),
}


@dataclass(frozen=True)
class TextModel:
    """A classifier by name, the text column it reads, and how its classes map to a label.

    A model that works on word counts has ``from_counts`` too, which takes the
    column of counts for the text: ``score_all`` counts once for all such models.
    """

    name: str
    text_col: str
    probabilities: Probabilities
    classes: str = "two_class"
    from_counts: Probabilities | None = None

    @property
    def label_col(self) -> str:
        return f"{self.name}_label"

    @property
    def score_col(self) -> str:
        return C.score_column_name(self.label_col)


def _filled(df: DataFrame, text_col: str, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(text_col), F.lit("")))


def _labelled(df: DataFrame, scored: DataFrame, model: TextModel, probs: str) -> DataFrame:
    label, score = _RULES[model.classes]
    return scored.select(
        *df.columns, label(probs).alias(model.label_col), score(probs).alias(model.score_col)
    )


def classify_text(df: DataFrame, model: TextModel) -> DataFrame:
    """Add ``<model>_label`` and ``<model>_score``; a missing text counts as empty."""
    text, probs = f"_{model.name}_text", f"_{model.name}_probs"
    scored = model.probabilities(_filled(df, model.text_col, text), text, probs)
    return _labelled(df, scored, model, probs)


def score_all(df: DataFrame, models: list[TextModel]) -> DataFrame:
    """Every model's columns on one lazy frame; words of a text column are counted once for all models."""
    columns = df.columns
    counted = {c: f"_counts{i}" for i, c in enumerate(dict.fromkeys(m.text_col for m in models if m.from_counts))}
    for column, name in counted.items():
        df = features(_filled(df, column, f"{name}_text"), f"{name}_text", words, name).drop(f"{name}_text")
    for model in models:
        if model.from_counts:
            probs = f"_{model.name}_probs"
            df = _labelled(df, model.from_counts(df, counted[model.text_col], probs), model, probs)
        else:
            df = classify_text(df, model)
    return df.select(*columns, *[c for m in models for c in (m.label_col, m.score_col)])


def bayes_model(
    name: str, train: DataFrame, text: str, label: str, text_col: str | None = None
) -> TextModel:
    fitted = fit_bayes(train, text, label)
    return TextModel(name, text_col or text, fitted.probabilities, from_counts=fitted.from_features)


def logistic_model(
    name: str,
    train: DataFrame,
    text: str,
    label: str,
    text_col: str | None = None,
    features: int = 1 << 14,
) -> TextModel:
    """Logistic regression on hashed, idf-weighted words; weights have a fixed size."""
    terms = "_terms"
    pipeline = Pipeline(
        stages=[
            HashingTF(inputCol=terms, outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_idf"),
            LogisticRegression(
                featuresCol="_idf", labelCol="_y", probabilityCol="_p", regParam=0.01, maxIter=30
            ),
        ]
    )
    data = train.filter(F.col(label).isNotNull()).select(
        words(F.col(text)).alias(terms), F.col(label).cast("double").alias("_y")
    )
    fitted = pipeline.fit(data)

    def probabilities(df: DataFrame, column: str, out: str) -> DataFrame:
        scored = fitted.transform(df.withColumn(terms, words(F.col(column))))
        return scored.select(*df.columns, vector_to_array("_p").alias(out))

    return TextModel(name, text_col or text, probabilities)


def external_model(
    name: str,
    text_col: str,
    make_predict: Callable[[], Callable],
    batch_size: int = 16,
    classes: str = "two_class",
) -> TextModel:
    """A model outside Spark, loaded once per Python worker and called on batches of texts.

    ``make_predict()`` returns a function from an array of n texts to an
    (n, classes) array of logits.
    """
    call = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size
    )

    def probabilities(df: DataFrame, column: str, out: str) -> DataFrame:
        with_logits = df.withColumn("_logits", call(F.col(column)))
        return with_logits.withColumn(out, C.softmax("_logits")).drop("_logits")

    return TextModel(name, text_col, probabilities, classes)


# Several answers to each of a list of prompts.
Generator = Callable[[list[str], int], list[list[str]]]


def prompted_answers(
    df: DataFrame, text: str, make_generator: Callable[[], Generator], samples: int = 5, batch_size: int = 16, out: str = "answers"
) -> DataFrame:
    """Add the ``samples`` outputs of a text generator for the prompt of each text.

    ``make_generator`` is called once in each Python worker.  The generator gets
    up to ``batch_size`` prompts at a time, so that all samples of a prompt come
    from one call; it may repeat the prompt before its answer.  A missing text
    counts as empty.
    """

    def make_predict() -> Callable[[np.ndarray], np.ndarray]:
        generate = make_generator()

        def predict(prompts: np.ndarray) -> np.ndarray:
            texts = [str(p) for p in prompts.reshape(-1)]
            answers = generate(texts, samples)
            if len(answers) != len(texts) or any(len(a) != samples for a in answers):
                raise ValueError(f"a generator must give {samples} answers to each of {len(texts)} prompts")
            table = np.empty((len(texts), samples), dtype=object)
            table[:] = answers
            return table

        return predict

    call = predict_batch_udf(make_predict, return_type=T.ArrayType(T.StringType()), batch_size=batch_size)
    return df.withColumn(out, call(C.build_prompt(F.coalesce(F.col(text), F.lit("")))))


def prompted_model(
    name: str,
    text_col: str,
    make_generator: Callable[[], Generator],
    samples: int = 5,
    batch_size: int = 16,
) -> TextModel:
    """A text generator asked whether a text is phishing, several times over.

    Each answer is read as a boolean, an unclear one as no; the label is the
    majority's (a tie is no) and the score the share of answers that agree with
    phishing.  Only the generator is Python, prompt, answers and vote are columns.
    """

    def probabilities(df: DataFrame, column: str, out: str) -> DataFrame:
        answered = prompted_answers(df, column, make_generator, samples, batch_size, "_answers")
        return answered.withColumn(out, C.answer_shares("_answers")).drop("_answers")

    return TextModel(name, text_col, probabilities)
