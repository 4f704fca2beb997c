import pytest

SCHEMA = "text string, doc_id bigint, lang string, source string, n_chars bigint, sha string, keep_id int, norm string, rank int"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, source[, lang]]) as documents with extra columns of clashing names."""

    def make(rows):
        full = [(r[1], r[0], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", None, "x", 1, "y", 2) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make
