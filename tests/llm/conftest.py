import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (doc_id, text[, source]) with the other columns and an extra one that clashes."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    return make
