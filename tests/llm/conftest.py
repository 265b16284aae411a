import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, spans int"


@pytest.fixture(scope="session")
def make_documents(spark):
    """Documents with extra columns whose names clash with those the operators use inside."""
    def make(rows):
        return spark.createDataFrame([(i, t, lang, source, len(t or ""), "k", 0.5, 1) for i, t, lang, source in rows], DOCUMENTS)
    return make
