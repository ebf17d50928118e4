import pytest


@pytest.fixture
def docs(spark):
    """A documents table with the awkward cases: nulls, empty and long texts, repeated rows, clashing columns."""

    def make(texts, start=0):
        rows = [(start + i, t, "en", f"s{i % 2}", 1, "x", 2) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, root int")

    return make
