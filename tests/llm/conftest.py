import pytest

LONG = " ".join(f"word{i % 977} and" for i in range(6000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.\nThe quick brown fox jumps over the lazy dog.\n\nEnd", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "   \n\t ", "fr", "b"),
    (5, "it's 12345 <|endoftext|> naïve ÉTÉ 日本語 👍🏽  x²", "fr", "b"),
    (6, LONG, "en", "a"),
    (6, LONG, "en", "a"),
    (7, "!!! ??? 123", "en", None),
    (None, "no id here but some words", None, "a"),
    (8, "a" * 5000 + " b", "en", "a"),
    (9, LONG.replace("word3 ", "word4 ", 1), "en", "a"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names clash with results."""
    rows = [(*r, 7, 0.5, "x", [1]) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, part string, ids array<int>")


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
