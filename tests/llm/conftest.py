import pytest

CLASH = "doc_id long, text string, lang string, source string, n_chars long, k string, m string, h string, fp string, sig string, digest string, component string, size string, seq string, u string, rank string, host string, file string, row string"


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text) with nulls, empty and very long texts, ties, repeated rows and equal ids."""
    long = " ".join(f"word{i % 977} thing{i % 31}" for i in range(20_000))
    return [(1, "a short text about nothing"), (2, None), (None, "no id here at all, friend"), (3, ""), (4, "   \n\t "), (5, long), (6, long), (7, "tie one two three four five"), (7, "tie one two three four five"), (8, "Zoë's ☃ naïve \U0001f600 text"), (9, "x"), (None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with columns whose names internals use too."""
    pad = len(CLASH.split(", ")) - 5
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["clash"] * pad) for i, t in odd_rows], CLASH).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], CLASH)
