"""The language network learns every label, however many there are."""

from mailrisk.llm import langid


def test_no_label_is_left_out(spark):
    rows = [(i, f"text of label {'abcdef'[i % 6] * 9}", f"l{i % 6}") for i in range(36)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = langid.fit(df, "doc_id", "text", "lang", sample=40)
    assert sorted(net.classes) == [f"l{k}" for k in range(6)]
