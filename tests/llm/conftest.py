import pytest

ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_shingles string, score string, part int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like results."""
    words = " ".join(f"word{i}" for i in range(9000))
    line = "the and of to in is that it be for on with as at by this an are was or " * 3
    rows = [
        (1, "", "en", "a", 0, "x", "y", 0),
        (2, None, None, None, None, None, None, None),
        (None, "lone text without an id", "en", "a", 5, "x", "y", 0),
        (3, words, "en", "a", len(words), "x", "y", 0),
        (4, words, "en", "a", len(words), "x", "y", 0),
        (4, words, "en", "a", len(words), "x", "y", 0),
        (5, words + " changed", "en", "a", 1, "x", "y", 0),
        (6, " \t\n\r\x0b\x0c ", "en", "a", 6, "x", "y", 0),
        (7, line + "\n" + line, "en", "a", 6, "x", "y", 0),
        (8, "漢字かな " * 400 + "🙂 é    　x ▁ ▁▁ \x00", "zh", "a", 6, "x", "y", 0),
        (9, "x" * 200_000, "en", "a", 200_000, "x", "y", 0),
    ]
    return spark.createDataFrame(rows, ODD_DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD_DOCS)
