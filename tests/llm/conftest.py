import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals of the forest today"
    rows = [
        (1, base, "en", "a", 10),
        (2, base, "en", "a", 10),
        (2, base, "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "fr", "b", 4),
        (6, base + " " + " ".join(f"w{i}" for i in range(20000)), None, "a", 1),
        (7, "short text", "de", None, 10),
        (8, "été naïve ÀÉ " * 8, "fr", "c", 100),
        (9, "# $ % & | < > * " * 12, "en", "a", 9),
    ]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], cols + ", row string, bin long, label string, _row long, bucket int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
