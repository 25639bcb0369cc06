import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with the other columns and some that clash with the operators' own names."""

    def make(rows, lang="en"):
        full = [(i, t, lang if not isinstance(lang, dict) else lang.get(i), "src", len(t or ""), 7, "x", 1.5) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, node int, class_id string, score double").repartition(3)

    return make
