import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties; a column whose name clashes with an output."""
    long = "one long text of words " * 20_000
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "hello there general words", "en", "a", 25),
        (4, "hello there general words", "en", None, 25),
        (5, long, "en", "b", len(long)),
        (6, "   \n\t ", None, "b", 6),
        (7, "12 34 !!", "fr", "b", 8),
        (8, "mail a.b@c.example now, call +1 (017) 555-7713 é", "fr", "c", 48),
        (8, "mail a.b@c.example now, call +1 (017) 555-7713 é", "fr", "c", 48),
    ]
    return spark.createDataFrame([(*r, 0.5) for r in rows], DOCS + ", score double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
