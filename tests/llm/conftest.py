import pytest


@pytest.fixture
def no_rows(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
    rows = [
        (1, None, "x", 1), (2, "", "x", 1), (3, "   \n", None, 2), (None, "no id here at all my friend", "y", None), (4, "The same text is here twice, for two ids.", "a", 1),
        (5, "The same text is here twice, for two ids.", "b", 2), (5, "The same text is here twice, for two ids.", "b", 2), (6, long, "c", 3), (7, "ßé <|endoftext|> 漢字 \U0001f600 it's  we'll\t\n\n 12345", "d", 4), (8, "one", "e", 5), (None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, shard int")
