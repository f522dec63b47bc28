import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as a DataFrame, from tuples and a schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
