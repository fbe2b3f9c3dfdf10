"""Every checked query against its SQL on the smallest data, and the shape of the entry points."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import check
from catalogue.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return connection


def test_entry_is_the_feature_table(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "user_id" and len(df.columns) == 112


def test_every_oracle_has_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(QUERIES) <= set(oracles)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, con, name):
    verdict = check.compare(spark, con, name, SMALL)
    assert verdict.startswith(("ok", "rows")) and "TYPES" not in verdict, verdict


@pytest.mark.parametrize("taken_out", [["tidemark.llm"], ["corpus_pipeline"], ["tidemark.llm", "corpus_pipeline"]])
def test_entry_works_without_the_optional_parts(taken_out):
    script = f"""
import sys

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in {taken_out}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
from catalogue.queries import QUERIES
assert set(QUERIES) <= set(entry.queries())
assert "pipeline" not in entry.queries()
assert any(n.startswith("op1_") for n in entry.queries()) == ("tidemark.llm" not in {taken_out})
assert set(entry.oracle_sql()) <= set(entry.queries())
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
