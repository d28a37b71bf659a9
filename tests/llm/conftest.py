import pytest


@pytest.fixture(scope="module")
def docs(spark):
    """Make documents from (doc_id, text[, lang, source]) rows, with a column that clashes with results."""

    def make(rows):
        rows = [(*r, *(None,) * (4 - len(r)), "x", 7.0) for r in rows]
        schema = "doc_id long, text string, lang string, source string, lang_pred string, score double"
        return spark.createDataFrame(rows, schema)

    return make
