import pytest


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


ODD = [
    (None, "a document without an id but with some words in it", "x"),
    (1, None, "x"),
    (2, "", "x"),
    (3, "   \n\t ", "x"),
    (4, "one", "x"),
    (5, "same text here, twice in the table", "x"),
    (5, "same text here, twice in the table", "x"),
    (6, "naïve 😀 中文 <|endoftext|> \x1c\x85\xa0 é é Σς", "x"),
    (7, "word " * 30000, "x"),
    (8, "0123456789abcdef" * 2000, "x"),
    (9, "\n".join(f"line {i} of a text that goes on" for i in range(3000)), "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and a column whose name clashes."""
    return spark.createDataFrame([(*r, 7) for r in ODD], "doc_id long, text string, source string, n_words int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
