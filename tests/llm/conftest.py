import pytest


@pytest.fixture
def frame(spark):
    """A small table from rows and a schema; an extra column whose name clashes with internal ones comes along."""

    def make(rows, schema="doc_id long, text string, source string, key string"):
        return spark.createDataFrame(rows, schema)

    return make
