"""The registered queries against their SQL, on the smallest tables."""

import os

import pytest
from llm.test_quality_rules import key

import __spark_entry__ as registered
from callscape.llm.oracle import ORACLE
from callscape.llm.queries import QUERIES
from checks.compare import sql_tables

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_all_are_registered():
    assert QUERIES.items() <= registered.queries().items()
    assert "pipeline" in registered.queries() and ORACLE.items() <= registered.oracle_sql().items()
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_and_sql_agree(spark, name):
    got = QUERIES[name](spark, SF)
    rows = sql_tables(SF).execute(ORACLE[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(got.columns)
    rounded = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    want = sorted(map(rounded, rows.fetchall()), key=key)
    assert sorted((rounded(r) for r in got.select(*names).collect()), key=key) == want
