import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, node string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "a", 48, 0.5, 1, "x"),
        (1, "one two three four five six seven eight nine ten", "en", "a", 48, 0.5, 1, "x"),
        (2, None, "en", "a", None, None, None, None),
        (3, "", "de", "b", 0, 0.1, 2, "y"),
        (None, "one two three four five six seven eight nine ten", None, None, None, 0.2, 3, "z"),
        (5, long, "en", None, len(long), 0.3, 4, "n"),
        (6, " \n\t ", None, "b", 4, 0.3, 4, "n"),
        (7, "ONE two three four five six seven eight nine ten", "en", "c", 48, 0.3, 4, "n"),
        (8, "1234 !!! ???", "de", "c", 12, 0.3, 4, "n"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
