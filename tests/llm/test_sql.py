"""Queries of this part against their SQL."""

from __future__ import annotations

import pytest

from cohortry.llm import oracles, queries
from tools.check_queries import compare

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, duck, name):
    df = queries.queries()[name](spark, sf_dir)
    cursor = duck.execute(SQL[name])
    want = ([d[0] for d in cursor.description], cursor.fetchall())
    assert compare((df.columns, [tuple(r) for r in df.collect()]), want) == ""
