"""Jobs: ingest, preprocess, labelling sheet, scoring, review sample."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk import schema as S
from mailrisk.functions import text as X
from mailrisk.operators import cohort, embeddings, geo, messages, ranking, report, rows
from mailrisk.operators.bayes import BayesModel
from mailrisk.operators.joins import lookup_join
from mailrisk.operators.language import Translator, detect_language, translate
from mailrisk.operators.scoring import TextModel, score_all
from mailrisk.session import stored
from mailrisk.sources import readers, writers
from mailrisk.sources.runs import Output, run_job


def ingest(
    raw: DataFrame, ranges: DataFrame, language: BayesModel, ranges6: DataFrame | None = None
) -> DataFrame:
    """Raw events to extracted mails with country, language, bodies and ``error``.

    One plan in which no body is shuffled: country is a broadcast range lookup,
    language and text are row-wise.  Rows with an ``error`` are for quarantine.
    """
    flat = messages.decode_subject(rows.flatten_event(raw))
    placed = geo.ip_country(flat, ranges, ranges6)
    spoken = detect_language(placed, language, "subject", "lang")
    extracted = messages.extract_messages(spoken, "mime")
    return extracted.withColumn("error", F.coalesce("parse_error", "subject_error")).drop(
        "parse_error", "subject_error"
    )


def write_ingested(
    raw: DataFrame,
    path: str,
    ranges: DataFrame,
    language: BayesModel,
    ranges6: DataFrame | None = None,
    batch: int = 0,
) -> None:
    """Raw events, as read by ``scan_json_lines``, to the tables of an ingest.

    Messages are parsed once, into ``parsed``; from there come ``mails``,
    ``html`` (one row per body) and ``quarantine`` (record, file, reason), each
    with a folder ``batch=<batch>`` that a repeated run overwrites.  Raw bodies
    are not stored again.  Nothing is lost: a record is a mail or in quarantine.
    """
    good, bad = readers.split_bad_records(raw)
    spark = raw.sparkSession
    writers.write_parquet(ingest(good, ranges, language, ranges6), f"{path}/parsed/batch={batch}")
    parsed, failed = split_errors(spark.read.parquet(f"{path}/parsed/batch={batch}"))
    writers.write_parquet(parsed.drop("html"), f"{path}/mails/batch={batch}")
    writers.write_html_bodies(parsed, f"{path}/html/batch={batch}")
    names = [c for c in failed.columns if c not in ("error", "s3_path")]
    failed = failed.select(F.to_json(F.struct(*names)).alias("record"), "s3_path", F.col("error").alias("reason"))
    writers.write_parquet(bad.unionByName(failed), f"{path}/quarantine/batch={batch}")


def suspended_cohort(
    mails: DataFrame,
    notes: DataFrame,
    marker: str,
    as_of: Column,
    months: int = 2,
    days: int = 3,
    upper: bool = False,
) -> DataFrame:
    """Mails sent in the days before the latest suspension noted in recent months."""
    suspended = cohort.suspended_users(rows.recent_notes(notes, marker, as_of, months))
    return cohort.suspension_window(mails, suspended, days=days, upper=upper)


def split_errors(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine); call it on the written table so that messages are parsed once."""
    good = extracted.filter(F.col("error").isNull()).drop("error")
    return good, extracted.filter(F.col("error").isNotNull())


def preprocess(
    extracted: DataFrame, translators: Mapping[str, Callable[[], Translator]] | None = None
) -> DataFrame:
    """Add link domains, cleaned text and translations of text and subject."""
    df = extracted.withColumns(
        {
            "url_domains": X.url_domains("email_text"),
            "cleaned_text": X.clean_email_text("email_text"),
            "subject": X.clean_basic("subject"),
        }
    )
    if not translators:
        return df.withColumn("translated_text", F.col("cleaned_text"))
    return translate(df, translators, {"cleaned_text": "translated_text", "subject": "subject"})


def write_preprocessed(
    extracted: DataFrame,
    path: str,
    translators: Mapping[str, Callable[[], Translator]] | None = None,
    msg_id: str = "msg_id",
    source: str = "s3_path",
) -> int:
    """Preprocess the mails of new sources into ``texts`` and ``domains`` (a row per mail and link domain)."""

    def domains(_todo: DataFrame, done: dict[str, DataFrame]) -> DataFrame:
        each = F.explode(F.split("url_domains", " "))
        return done["texts"].select(msg_id, each.alias("domain")).filter("domain <> ''")

    outputs = [Output("texts", lambda todo, _: preprocess(todo, translators)), Output("domains", domains)]
    return run_job(extracted, path, outputs, spread=msg_id, source=source)


def labeling_sheet(
    mails: DataFrame,
    suspended: DataFrame,
    links: DataFrame,
    translators: Mapping[str, Callable[[], Translator]] | None = None,
    days: int = 3,
    dropped: Iterable[str] = ("filename", "email_text", "cleaned_text", "content_type", "s3_path", "mime"),
) -> DataFrame:
    """Mails of the days before suspension, translated, with file links, without body and model columns."""
    window = cohort.suspension_window(mails, suspended, days=days)
    if translators:
        window = translate(window, translators, {"subject": "subject", "cleaned_text": "translated_text"})
    linked = cohort.attach_file_links(window, links)
    rows.assert_has_column(linked, "filename")
    return rows.drop_matching(rows.drop_columns(linked, *dropped), ("_label", "_score"))


def write_labeling_sheet(
    mails: DataFrame,
    suspended: DataFrame,
    links: DataFrame,
    path: str,
    translators: Mapping[str, Callable[[], Translator]] | None = None,
    days: int = 3,
    source: str = "s3_path",
    order: tuple[str, ...] = ("user_id", "msg_id"),
) -> int:
    """Labelling sheet of new sources as numbered CSV, ``sheet``, and in ``unmapped`` how many of its mails have no file."""
    outputs = [
        Output("sheet", lambda todo, _: labeling_sheet(todo, suspended, links, translators, days), csv=True, number_by=order),
        Output("unmapped", lambda _, done: cohort.count_unmapped(done["sheet"], links)),
    ]
    return run_job(mails, path, outputs, spread="msg_id", source=source)


def score(
    mails: DataFrame,
    models: list[TextModel],
    translators: Mapping[str, Callable[[], Translator]] | None = None,
) -> DataFrame:
    """Cleaned text, subject with body, link domains and every model's columns, as one plan."""
    df = mails.withColumn("cleaned_text", X.clean_email_text("email_text"))
    df = df.withColumns(
        {
            "subject_body": X.subject_body("subject", "cleaned_text"),
            "url_domains": X.url_domains("email_text"),
        }
    )
    if translators:
        df = translate(df, translators, {"subject_body": "translated_text"})
    else:
        df = df.withColumn("translated_text", F.col("subject_body"))
    return score_all(df, models)


def write_scores(
    mails: DataFrame,
    models: list[TextModel],
    path: str,
    translators: Mapping[str, Callable[[], Translator]] | None = None,
    source: str = "s3_path",
) -> int:
    """Score the mails of new sources: ``scores`` has every model's columns, ``figures`` the counts and shares of each model."""
    names = [m.name for m in models]

    def figures(_todo: DataFrame, done: dict[str, DataFrame]) -> DataFrame:
        return report.model_report(report.long_scores(done["scores"], names, []), ["model"])

    outputs = [Output("scores", lambda todo, _: score(todo, models, translators)), Output("figures", figures)]
    return run_job(mails, path, outputs, spread="msg_id", source=source)


def review_sample(
    frames: dict[str, DataFrame], score_col: str, n: int = 50, key: str = "msg_id"
) -> DataFrame:
    """The n highest scores of each data set, review columns only, as one frame."""
    wanted = [*S.REVIEW_COLUMNS, score_col]
    rows.assert_unique_columns(*frames.values())
    tagged = [rows.tag_dataset(df, name).select(*wanted) for name, df in frames.items()]
    return ranking.top_n_per_dataset(rows.union_frames(*tagged), n, score_col, key)


def score_report(
    frames: dict[tuple[str, str], DataFrame], models: list[str], histograms: bool = False
) -> DataFrame:
    """Label figures per data set, kind of input (text or url) and model.

    With ``histograms`` each row also has ``histogram``, the number of rows in
    each of the bins between its smallest and largest score, and
    ``histogram_above``, the same for scores at or above the threshold.
    """
    parts = [
        report.long_scores(df, models, []).withColumns(
            {"dataset": F.lit(dataset), "input": F.lit(kind)}
        )
        for (dataset, kind), df in frames.items()
    ]
    long, by = rows.union_frames(*parts), ["dataset", "input", "model"]
    if not histograms:
        return report.model_report(long, by)
    long = stored(long, "scores")  # scores can be costly, and three aggregates read them
    out = report.model_report(long, by)
    for name, threshold in (("histogram", None), ("histogram_above", report.THRESHOLD)):
        bins = report.score_histogram(long, by, threshold=threshold)
        counts = F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda b: b["n"])
        out = out.join(bins.groupBy(*by).agg(counts.alias(name)), by, "left")
    return out


def compare_embeddings(
    corpus: DataFrame,
    others: Mapping[str, DataFrame],
    positive: str,
    negative: str,
    text: str = "text",
    label: str = "label",
    key: str = "id",
    per_set: int | None = None,
    dim: int = 256,
    labels: DataFrame | None = None,
) -> DataFrame:
    """(id, dataset, embedding): the corpus cut by its label into two sets, and other sets of texts.

    ``labels`` is a table of (key, label) where the corpus has no label column;
    texts become vectors before it is joined, so they do not move.
    ``per_set`` takes an exact sample of each set, the same one every time.
    The table is stored: distances, centroids and clusters all read it.
    """

    def embedded(df: DataFrame, *more: str) -> DataFrame:
        named = df.select(F.col(key).alias("id"), F.col(text).alias("_text"), *more)
        return embeddings.embed_text(named, "_text", dim).drop("_text")

    if labels is None:
        known = embedded(corpus, F.col(label).alias("_label"))
    else:
        named = labels.select(F.col(key).alias("id"), F.col(label).alias("_label"))
        known = lookup_join(embedded(corpus), named, "id", spread="id", how="inner")
    dataset = F.when(F.col("_label") == 1, positive).when(F.col("_label") == 0, negative)
    parts = [known.withColumn("dataset", dataset).filter("dataset IS NOT NULL").drop("_label")]
    parts += [rows.tag_dataset(embedded(df), name) for name, df in others.items()]
    sets = rows.union_frames(*parts).select("id", "dataset", "embedding")
    if per_set is not None:
        sets = ranking.sample_n(sets, per_set, "dataset", "id")
    return stored(sets, "embedding-sets")


def embedding_distances(sets: DataFrame, names: list[str]) -> DataFrame:
    """(set_a, set_b, similarity, distance) of each two of the named sets."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    near = embeddings.centroid_similarity(sets, pairs)
    return near.join(embeddings.mean_pairwise_distance(sets, pairs), ["set_a", "set_b"])


def embedding_map(sets: DataFrame, names: list[str]) -> DataFrame:
    """(id, dataset, cluster, x, y) of the rows of the named sets: a plane, and as many clusters as sets."""
    chosen = sets.filter(F.col("dataset").isin(names))
    points, _centres = embeddings.pca_kmeans(chosen, k=len(names))
    return points.select("id", "dataset", "cluster", "x", "y")
