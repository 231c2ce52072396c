import pytest

ODD = ["", " \t\n ", "...", "a", "Word word WORD", "é ü ñ", "\x1c\x1d odd \x85 spaces 　 here", "naïve <|endoftext|> it's 123 don't", "x" * 5000, "one two three four five " * 400, "line\nline\n\nline\n", "日本語 текст 𝔘𝔫𝔦", None, None, ""]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, long and strange texts, repeated rows, a null id, and columns whose names clash with common ones."""
    rows = [(i, t, "en" if i % 3 else None, "src" if i % 2 else None, -1) for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "a row without an id", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in ("label", "v", "key", "row", "h", "n_words", "length", "count", "__row")})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def more_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
