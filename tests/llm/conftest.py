import pytest

LONG = "the quick brown fox " * 6000 + "jumps"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns that clash with results."""
    rows = [
        (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 5, "x"),
        (2, None, "en", "a", None, None),
        (3, "", None, None, 0, "y"),
        (4, " \t\n ", "de", "b", 3, "z"),
        (5, LONG, "en", "b", 1, "z"),
        (6, "ÄÖÜ größe straße über grün été où çà λόγος", "de", None, 2, ""),
        (7, "1234 5678 -- ++", "fr", "c", 2, ""),
        (None, "one two three four five six seven eight nine ten eleven twelve.", "en", "a", 5, "x"),
        (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 5, "x"),
    ]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_words bigint, score string"
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
