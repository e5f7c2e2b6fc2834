import pytest


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows and columns of clashing names."""
    rows = [
        (1, None, "en", "a", 0, "x"), (2, "", None, "a", 0, None), (3, "   \n\t ", "en", None, 5, "x"), (None, "no id at all", "en", "b", 12, "x"),
        (4, "word " * 60_000, "en", "b", 300_000, "x"), (5, "one", "en", "a", 3, "x"), (5, "one", "en", "a", 3, "x"), (6, "the same few words here", "en", None, 23, "y"),
        (7, "the same few words here", "fr", "ü", 23, "y"), (8, "ÉTÉ naïve 日本語   x" + "\x00", "fr", "ü", 20, "y"), (9, "y" * 70_000, "de", "c", 70_000, "y"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
