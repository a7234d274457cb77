import pytest


@pytest.fixture(scope="session")
def texts(spark, sf):
    """doc_id -> text of the smallest documents table."""
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture()
def docs(spark):
    """A function: rows of (doc_id, text) as a documents table with columns whose names clash with outputs."""

    def make(rows, extra=("kept", "part", "id", "length")):
        schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in extra)
        return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in rows], schema)

    return make
