import pytest

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", "a", 57, 1.5),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", "a", 57, 2.5),
    (3, None, "en", None, None, None),
    (4, "", None, "b", 0, 0.0),
    (5, " \t\n\x0b\x0c\r", "en", "b", 6, 0.0),
    (6, "two words", "en", None, 9, 0.0),
    (6, "two words", "en", None, 9, 0.0),
    (7, "Ünï cödé ☃ 🐈 ###\nline with text here\nline with text here\n\nend", "fr", "c", 60, 0.0),
    (8, "word " * 30000, "en", "c", 150000, 0.0),
    (9, "x" * 200000, "en", "", 200000, 0.0),
    (None, "a row without an id, which has some words in it", "en", "c", 47, 0.0),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, copies double").withColumnsRenamed({"copies": "size"})


@pytest.fixture(scope="session")
def no_docs(odd):
    return odd.where("false")
