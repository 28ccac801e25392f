import pytest


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text) rows, with the columns of the table."""

    def build(*rows, parts=3):
        full = [(i, t, "en", f"src{n % 3}", len(t or "")) for n, (i, t) in enumerate(rows)]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        return spark.createDataFrame(full, schema).repartition(parts)

    return build
