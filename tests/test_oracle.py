"""Every query with checking SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, connection, name):
    assert compare(entry.queries()[name](spark, SF_DIR), connection, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql(spark, name):
    """Rows come back; what they must be is tested part by part."""
    assert len(entry.queries()[name](spark, SF_DIR).collect()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
