"""Small tables and helpers of the tests of areaspark.llm."""

import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Frames from rows and a schema, dealt over a few partitions."""

    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
