import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """rows(schema, [tuples]) -> DataFrame"""
    return lambda schema, data: spark.createDataFrame(data, schema)
