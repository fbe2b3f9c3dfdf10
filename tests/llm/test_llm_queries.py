"""Every registered operator against its SQL, and on edge rows, empty tables and clashing columns."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from tidemark.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return connection


def test_all_operators_are_registered():
    names = entry.queries()
    for number in range(1, 14):
        assert sum(n.startswith(f"op{number}_") for n in names) == 1
    assert "pipeline" in names and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_operator_matches_its_sql(spark, con, name):
    verdict = check.compare(spark, con, name, SMALL)
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
