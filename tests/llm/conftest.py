import pytest
from cases import CLASHES, SCHEMA, edge_rows
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names the operators use inside."""

    def add(df):
        return df.withColumns({c: F.lit("other") for c in CLASHES if c not in df.columns})

    return add
