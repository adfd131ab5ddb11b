"""The registered queries against their SQL, and what they must not hold."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import __spark_entry__ as contract
from phraseloom.llm import oracle, queries
from tests.compare import connect, difference

SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, sf_dir, con, name):
    assert difference(queries.queries()[name](spark, sf_dir), con, SQL[name]) is None


def test_all_operators_and_the_pipeline_are_registered():
    names = contract.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert "pipeline" in names


def test_nothing_else_imports_this_package():
    root = Path(queries.ROOT)
    files = [p for p in (root / "phraseloom").rglob("*.py") if "llm" not in p.parts] + [root / "oracle.py", root / "bench.py"]
    assert not [p for p in files if "phraseloom.llm" in p.read_text()]


@pytest.mark.parametrize("name", ["op3_secret_scan", "op9_url_filter"])
def test_native_operators_run_no_python(spark, sf_dir, name):
    plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
