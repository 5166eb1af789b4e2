from wattframe.llm import language as L

DOCS = "doc_id long, text string, lang string"


def test_a_language_of_a_few_long_texts_is_learned(spark):
    rows = [(i, "the quick brown fox jumps " * 2000, "en") for i in range(1, 7)]
    rows += [(i, "быстрая лиса прыгает " * 2000, "ru") for i in range(7, 13)]
    model = L.train(spark.createDataFrame(rows, DOCS), train_bytes=1)
    assert model.langs == ["en", "ru"]
