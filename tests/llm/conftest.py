import pytest

EDGES = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \t\n ", "b"),
    (5, "one two three", "a"),
    (6, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf", "b"),
    (7, "x" * 300_000, "a"),
    (8, "lorem ipsum dolor sit amet\n" * 4000, "a"),
    (9, "naïve café 猫犬 😀 it's we'll 123,456.78\n\n  end", None),
    (9, "a second row of the same id", "c"),
    (None, "a row without an id", "c"),
    (10, "word " * 10 + "ſecret=abcdef Kelvin", "a"),
]


@pytest.fixture
def edges(spark):
    """Null, empty and long texts, repeated and missing ids, and extra columns whose names operators use as well."""
    rows = [(i, t, s, 0, 1.5, "k") for i, t, s in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, n_words double, spans string")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
