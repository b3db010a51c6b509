import pytest

SF = "/root/testdata/sf0.001"

#: Nulls in every column, empty and blank texts, ties, repeated rows, and a long text.
HARD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \n\t ", "fr", "b"),
    (6, "Ünïcode naïve café ÀÉ", "fr", None),
    (7, "12345 !!! 678", None, "c"),
    (None, "no id here at all, none", "en", "a"),
    (None, None, None, None),
    (8, "word " * 30_000, "en", "c"),
    (9, "a  b\n\nc <|endoftext|> 's", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, score double, label long, rank int, n long"


@pytest.fixture(scope="session")
def hard(spark):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3) for r in HARD], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
