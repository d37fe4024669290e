import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with the other columns filled in."""

    def make(rows):
        filled = [(i, t, "en", f"src{(i or 0) % 4}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(filled, "doc_id long, text string, lang string, source string, n_chars long")

    return make
