import pytest

from .llm_helpers import prose

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = prose(1, 20_000)
    rows = [
        (1, prose(2, 120), "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", None, "b", 4),
        (5, prose(2, 120), "en", "a", 5), (5, prose(2, 120), "en", "a", 5), (6, long_text, "xx", "b", len(long_text)), (None, prose(3, 60), "en", None, 9),
        (None, None, None, None, None), (7, "one two", "en", "c", 7), (8, "12345 678 !!", "en", "c", 12), (9, prose(2, 119) + " changed", "en", "c", 1),
    ]
    clash = ("size", "score", "kept", "n_words", "piece", "start", "length", "lang_pred", "copies", "tie", "text_hash")
    schema = DOCS + "".join(f", {c} string" for c in clash)
    return spark.createDataFrame([(*r, *["x"] * len(clash)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
