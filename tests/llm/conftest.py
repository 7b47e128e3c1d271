import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows of documents; each row may leave out its last values."""

    def make(*rows):
        return spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], DOCS)

    return make
