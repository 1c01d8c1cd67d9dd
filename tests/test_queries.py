"""Every registered query gives the rows of its SQL."""

import os

import pytest

import __spark_entry__ as entry
import oracle
from meterflow.plans.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert oracle.differences(con, entry.queries()[name](spark, SF_DIR), ORACLES[name]) == []


def test_flagship(spark):
    result = entry.entry(spark)
    assert result.columns == ["series", "gts", "cnt", "peak", "cumul", "use", "prev_ns"]
    assert result.count() > 0
