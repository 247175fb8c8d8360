import pytest

from emberfold.llm.common import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def odd_docs(spark):
    """Null and empty texts, a null key, ties, repeated rows, white space only, a long text, and columns with clashing names."""
    long = "word " * 3 + " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    rows = [
        (1, None, "en", None, 0, "size", 1),
        (2, "", "de", "a", 0, "size", 2),
        (3, " \t\n\r\x0b\x0c ", None, "a", 7, "size", 3),
        (4, "the cat and the dog sat on the mat", "en", "b", 34, "size", 4),
        (4, "the cat and the dog sat on the mat", "en", "b", 34, "size", 4),
        (5, "the cat and the dog sat on the mat", "en", "b", 34, "size", 5),
        (None, "Ünïcödé ſtraße — emoji 😀 «quotes»", "xx", "é", 20, "size", 6),
        (7, long, "en", "b", len(long), "size", 7),
        (8, "one", "fr", "a", 3, "size", 8),
        (9, "x" * 5000, "es", None, 5000, "size", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, kept long").repartition(3)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")
