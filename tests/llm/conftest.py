import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, source) as documents, with two extra columns whose names operators use themselves."""

    def make(*rows):
        full = [(i, t, "en", s, None if t is None else len(t), 7, "x") for i, t, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make


ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t ", None),
    (4, "one", "b"),
    (5, "one", "b"),
    (5, "one", "b"),
    (None, "two words", "b"),
    (6, "é è 日本 語 " * 20, None),
    (7, "long text of words, " * 4000, "a"),
]


@pytest.fixture
def odd(documents):
    return documents(*ODD)


@pytest.fixture
def empty(documents):
    return documents(*ODD).where("doc_id = -1")
