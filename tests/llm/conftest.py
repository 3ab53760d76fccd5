import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _words string, kept string"

ODD = [
    None,
    "",
    " \t\n",
    "one",
    "two  words\n",
    "naïve café ﬁn Ωmega ΣΑΣ\x1c x　y\xa0z 12345 don't WE'LL  \n\n end",
    "same line here now again\nsame line here now again\nsame line here now again",
    "x" * 5000,
    "long " * 3000,
    "<|endoftext|> <0x0A> ▁▁ ▁a 日本語 🙂🙂",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None, "x", "y") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [(3, "one", "en", "s", 3, None, None), (None, "no id", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark):
    """Real texts of the smallest table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
