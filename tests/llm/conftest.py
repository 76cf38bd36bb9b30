import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, and clashing columns."""
    long_ = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 5, "x", 7),
        (2, "alpha BETA gamma delta epsilon zeta", "en", "a", 5, "x", 7),
        (2, "alpha BETA gamma delta epsilon zeta", "en", "a", 5, "x", 7),
        (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "x", 7),
        (None, "no id here at all in this row", "en", "b", 1, "x", 7),
        (None, None, None, None, None, None, None),
        (5, long_, "en", None, 9, "x", 7),
        (6, long_ + " end", "en", None, 9, "x", 7),
        (7, "ÀÉ naïve Σίσυφος 𝒳 emoji 😀 token = 'abcdefghijkl0123'", "fr", "", -1, "x", 7),
        (8, "  \t\n ", "fr", "", 3, "x", 7),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, `_digest` int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
