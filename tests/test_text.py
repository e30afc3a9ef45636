"""Text functions against plain Python on random strings, and golden cases."""

import random
import re
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from mailrisk.functions import scores as C
from mailrisk.functions import text as X

PIECES = [
    "http://", "https://", "www.", "HTTP://", "a.example", "b-c.example", "/", "/x?y=1", "?q", "#f", ":80", "@", " ", "\n", "\t",
    " ", "‌", " ", "　", "\x00", "\x1f", "\x7f", "\x85", "\x9f", "é", "文", "%20", "&", "=", "_", "-", ".", "(", ")",
    "TRUE", "FALSE", "true", "False", "xtrue", "T", "F",
]


def random_texts(n=3000, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def links(text):
    return re.finditer(r"(?:https?://|www\.)[\w./?=\-#%&]+", text, re.ASCII)


def host_of(link):
    full = link if link.startswith("http") else "http://" + link
    netloc = urlsplit(full).netloc
    if not netloc:
        return None
    return full.split("://")[0] + "://" + netloc if link.startswith("http") else netloc


def py_clean(text):
    text = "".join(" " if ord(c) < 32 or 127 <= ord(c) < 160 or c in "‌ " else c for c in text)
    return " ".join(text.split())


def py_shorten(text):
    out, end = [], 0
    for m in links(text):
        out += [text[end : m.start()], host_of(m.group()) or m.group()]
        end = m.end()
    return "".join(out) + text[end:]


def py_domains(text):
    return " ".join(sorted({host_of(m.group()) for m in links(text)} - {None}))


def py_vote(text):
    votes = re.findall("TRUE|FALSE", text.replace(" ", "").upper())[:5]
    return int(votes.count("TRUE") >= 3)


def py_flag(text):
    m = re.search(r"\b(true|false)", text, re.IGNORECASE)
    return int(bool(m) and m.group(1).lower() == "true")


@pytest.fixture(scope="module")
def results(spark):
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    rows = df.select(
        "i",
        X.clean_basic("t").alias("basic"),
        X.clean_email_text("t").alias("clean"),
        X.url_domains("t").alias("domains"),
        X.strip("t").alias("strip"),
        C.majority_vote("t").alias("vote"),
        C.parse_boolean(F.translate("t", "é文", "")).alias("flag"),
    ).collect()
    return [(texts[r["i"]], r) for r in rows]


@pytest.mark.parametrize(
    "column, oracle",
    [
        ("basic", py_clean),
        ("clean", lambda t: py_clean(py_shorten(t))),
        ("domains", py_domains),
        ("strip", str.strip),
        ("vote", py_vote),
        ("flag", lambda t: py_flag(t.replace("é", "").replace("文", ""))),
    ],
)
def test_random_strings(results, column, oracle):
    wrong = [(t, r[column], oracle(t)) for t, r in results if r[column] != oracle(t)]
    assert not wrong, wrong[:3]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("see https://a.example/x?y=1 now", "see https://a.example now"),
        ("www.a.example/x", "www.a.example"),
        ("http:///x", "http:///x"),
        ("http://a.example:80/x", "http://a.example:80/x"),
        (None, ""),
    ],
)
def test_clean_cases(spark, text, expected):
    assert one(spark, X.clean_email_text(F.lit(text).cast("string"))) == expected


def test_small_functions(spark):
    lit = F.lit
    assert one(spark, X.url_domains(lit("http://b.example/1 http://b.example/2 www.a.example"))) == "http://b.example www.a.example"
    assert one(spark, X.base_lang(lit("zh-cn"))) == "zh"
    assert one(spark, X.normalise_charset(lit("3DUTF-8"))) == "utf-8"
    assert one(spark, X.hyperlink(lit(""))) == "Not Found"
    assert one(spark, X.hyperlink(lit(None).cast("string"))) == "Not Found"
    assert one(spark, X.user_from_path(lit("s3://b/users/42/f.json"))) == "42"
    assert one(spark, X.user_from_path(lit("file:/b/users/uid=42/f.json"))) == "42"
    assert one(spark, X.html_key(lit(None).cast("string"))) is None
    assert one(spark, C.parse_boolean(lit("FALSETRUETRUETRUE"))) == 0
    assert one(spark, C.parse_boolean(lit("xtrue"))) == 0
    assert one(spark, C.parse_boolean(lit(None).cast("string"))) == 0
    assert one(spark, C.majority_vote(lit("TRUEFALSE xTRUETRUE"))) == 1
    assert one(spark, C.extract_answer(lit("p <<ANSWER>>: a <<ANSWER>>:\n b "))) == "b"
    assert one(spark, C.extract_first_answer(lit("p <<ANSWER>>: a <<ANSWER>>:\n b "))) == "a"
    assert C.score_column_name("m_x_label") == "m_x_score"


@pytest.mark.parametrize(
    "probs, label, score, label_of, score_of",
    [
        ([0.8, 0.2], 0, 0.2, C.label_two_class, C.score_two_class),
        ([0.5, 0.5], 0, 0.5, C.label_two_class, C.score_two_class),
        ([0.4, 0.3, 0.05, 0.25], 0, 0.6, C.label_four_class, C.score_four_class),
        ([0.1, 0.2, 0.3, 0.4], 1, 0.4, C.label_four_class, C.score_four_class),
    ],
)
def test_scores(spark, probs, label, score, label_of, score_of):
    p = F.array(*[F.lit(x) for x in probs])
    assert one(spark, label_of(p)) == label
    assert one(spark, score_of(p)) == pytest.approx(score)


def test_named_score(spark):
    assert one(spark, C.score_named(F.lit("benign"), F.lit(0.9))) == pytest.approx(0.1)
    assert one(spark, C.label_named(F.lit("phishing"))) == 1
