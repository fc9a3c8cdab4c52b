"""Every registered analysis against its SQL text on the smallest tables; the
lagged daily models need the denser calendar of the next size."""

import pytest

import __spark_entry__ as entry_points
from compare import connect, mismatch
from lagloom.plans import registry

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ALL = entry_points.queries()
QUERIES = {k: ALL[k] for k in registry.QUERIES}
ORACLE = {k: v for k, v in entry_points.oracle_sql().items() if k in QUERIES}


def folder_of(name):
    return MEDIUM if name.startswith(("dlnm_", "dlm_", "cox_dlnm")) else SMALL


@pytest.fixture(scope="module")
def cons():
    return {f: connect(f) for f in (SMALL, MEDIUM)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, cons, name):
    folder = folder_of(name)
    assert mismatch(spark, cons[folder], QUERIES[name], ORACLE.get(name), folder) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
