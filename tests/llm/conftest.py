import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents ``(doc_id, text)`` with more columns whose names clash with results."""

    def documents(rows, partitions=3):
        data = [(i, t, "x", 7, "k") for i, t in rows]
        schema = "doc_id long, text string, kept string, n_words int, `a.b` string"
        return spark.createDataFrame(data, schema).repartition(partitions)

    return documents
