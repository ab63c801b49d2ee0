import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table: rows of (doc_id, text) or (doc_id, text, source), with columns that clash."""

    def make(rows, **more):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", 0, "x", 1) for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, shard string, count long"
        ).repartition(3)

    return make
