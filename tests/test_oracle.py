"""Every registered query against its SQL, on the smallest data set."""

import pytest

import __spark_entry__ as entry
import check
from fieldobs.workload import load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.oracle(SF)


def test_every_query_has_sql():
    assert set(load().QUERIES) == set(load().ORACLE)
    assert set(entry.queries()) >= set(load().QUERIES)


@pytest.mark.parametrize("name", list(load().QUERIES))
def test_query_equals_sql(spark, con, name):
    result = check.compare(spark, con, SF, name)
    assert result.startswith("ok") and "TYPES" not in result and "FAIL" not in result, result


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
