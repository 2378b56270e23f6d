"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import workload
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_matches_sql(spark, con, name):
    got = workload.QUERIES[name](spark, FOLDER).toPandas()
    assert name in workload.ORACLE
    assert compare(got, con.execute(workload.ORACLE[name]).df()) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert workload.QUERIES.keys() == workload.ORACLE.keys()
    assert workload.QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()
    assert not entry.entry(spark).isEmpty()
