import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A ``documents`` table of texts, with extra columns whose names clash with the operators' own."""
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, None, "src0", 0, "x", 7, "y") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "fingerprint string, length int, ids string")
    return make
