import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __row string"


@pytest.fixture
def make(spark):
    """Documents from texts; the extra column's name clashes with names that operators use inside."""

    def of(texts, source="s", lang="en", ids=None):
        rows = []
        for i, t in enumerate(texts):
            rows.append((ids[i] if ids else i, t, lang, source[i] if isinstance(source, list) else source, len(t or ""), "x"))
        return spark.createDataFrame(rows, DOCS)

    return of
