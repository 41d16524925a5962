import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_key string, size string"


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text[, source]) rows, with extra columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", "y") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
