import pytest


@pytest.fixture
def make(spark):
    """Documents with awkward extra columns: names that the operators use inside."""

    def build(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en" if k % 2 else None, None, None, 1.5, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key string")

    return build
