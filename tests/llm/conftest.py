"""Edge rows that every operator on documents has to take."""

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, ids string, key string"


@pytest.fixture(scope="session")
def edge_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, odd characters and columns whose names operators use themselves."""
    long = " ".join(f"word{k % 977} und" for k in range(60_000))
    prose = "the cat and the dog went to the old house by the river on a cold day"
    texts = [(1, None, None), (2, "", "en"), (3, " \n\t ", None), (4, "!!! 123", "en"), (5, prose, "en"), (6, prose, "en"), (6, prose, "en"), (7, long, "de"), (8, "a", "fr"), (9, "日本語 \U0001f600 <|endoftext|> \x00", None), (None, prose, None), (10, "Dr. Anna Smith a@b.co +1 (988) 555-2485", "en")]
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "y") for i, t, lang in texts], COLUMNS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)
