"""Every registered query against its SQL on the smallest tables."""

import importlib.util
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"

spec = importlib.util.spec_from_file_location("check", ROOT / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(check.contract.queries()))
def test_query_matches_sql(spark, con, name):
    ok, note = check.compare(spark, con, SF, name)
    assert ok, note


def test_queries_without_sql_are_known():
    without = set(check.contract.queries()) - set(check.contract.oracle_sql())
    # those on text have their own tests
    assert not {n for n in without if n != "pipeline" and not n.startswith("op")}


def test_all_sql_belongs_to_a_query():
    assert set(check.contract.oracle_sql()) <= set(check.contract.queries())


def test_entry(spark):
    assert check.contract.entry(spark).count() == 1
