"""Every registered query of the library against its SQL counterpart, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, sql_tables
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return sql_tables(SF)


def test_every_counterpart_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= queries().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    verdict = compare(spark, db, SF, name)
    assert verdict.split()[0] in ("equal", "rows-only"), verdict


def test_entry(spark):
    assert entry(spark).count() > 0
