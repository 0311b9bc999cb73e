import pytest

DOCS = "doc_id long, text string"


@pytest.fixture
def docs_of(spark):
    return lambda rows: spark.createDataFrame(rows, DOCS)
