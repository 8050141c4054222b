import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, bucket int, n_tokens string, component string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls everywhere, empty and very long texts, ties and repeats, and columns whose names operators use."""
    long = " ".join(f"word{i}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog and runs away from all the people in town " * 4
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base.upper(), "en", None),
        (4, None, "en", "b"),
        (5, "", None, "b"),
        (6, " \n\t ", "de", "b"),
        (7, long, "de", "a"),
        (7, long, "de", "a"),
        (8, "one", "fr", "c"),
        (8, "two words", "fr", "c"),
        (None, "a text without an id", None, None),
        (None, None, None, None),
        (9, "😀 é ́ <|endoftext|> \x1c x", "en", "a"),
        (10, "1234 !!! ---", "en", "a"),
        (11, "x" * 50_000, "en", "a"),
    ]
    return spark.createDataFrame([(*r, None, "k", 1, 2, "t", "c") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
