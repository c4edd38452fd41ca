"""Every registered query against its SQL; queries without SQL must give rows."""

from __future__ import annotations

import pytest

from cohortry.plans import oracle_sql, queries
from tools.check_queries import compare

QUERIES, SQL = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = (df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got[1]
        return
    cursor = duck.execute(SQL[name])
    want = ([d[0] for d in cursor.description], cursor.fetchall())
    assert compare(got, want) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
