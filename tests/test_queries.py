"""Every registered query against its SQL."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from jobvigil.plans.oracle import ORACLE
from jobvigil.plans.queries import QUERIES
from tests.compare import database, difference

ROWS_ONLY = {"forest_model", "forest_verdicts"}


@pytest.fixture(scope="module")
def sql(sf_dir) -> duckdb.DuckDBPyConnection:
    return database(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, sf_dir, sql, name):
    ours = contract.queries()[name](spark, sf_dir).toPandas()
    assert difference(ours, sql.sql(contract.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_gives_rows(spark, sf_dir, name):
    assert contract.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    root = Path(contract.__file__).parent
    shutil.copytree(root / "jobvigil", tmp_path / "jobvigil", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split() == sorted(QUERIES)
