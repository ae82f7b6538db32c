import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Frame of (doc_id, text, source) rows with an extra column whose name operators use inside."""
    def make(rows):
        return spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "doc_id long, text string, source string, n string")
    return make
