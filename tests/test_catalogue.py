"""Every core query with SQL gives the SQL's rows on the smallest tables; the others run."""

from __future__ import annotations

import os

import pytest

from compare import connect, differ
from sonoplan.plans import arrays, catalogue, problems, reports

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ALL = {n: (q, part.SQL.get(n)) for part in (catalogue, arrays, reports, problems) for n, q in part.QUERIES.items()}


@pytest.fixture(scope="session")
def tables():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, tables, name):
    query, sql = ALL[name]
    if sql:
        assert differ(spark, tables, FOLDER, name, query, sql) == ""
    else:
        assert query(spark, FOLDER).count() >= 0
