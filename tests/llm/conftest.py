import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, size string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents with columns whose names operators also use."""

    def make(rows):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a",
             len(r[1] or ""), "s", "k", "z")
            for r in rows
        ]
        return spark.createDataFrame(full, WIDE)

    return make
