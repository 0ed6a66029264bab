"""Language ID learns every label that the training rows have."""

from velonet.llm import langid


def test_no_label_is_left_out(spark):
    labels = [f"l{i:03d}" for i in range(300)]
    rows = [(i, f"word{lang} of {lang} " * 5, lang) for i, lang in enumerate(labels * 8)]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.langs == tuple(labels)
