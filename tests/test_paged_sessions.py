"""Queries with one row a session give the same rows at any page size."""

import pytest

from seqwarden.catalog import incidents as queries
from seqwarden.operators import incidents as inc


@pytest.mark.parametrize("query", [queries.q27, queries.q37, queries.q38])
def test_page_size_changes_nothing(spark, query):
    small = "/root/testdata/sf0.001"
    pages = queries.incident_table(spark, small, 2)
    assert pages.filter("page > 1").count() > 0
    want = sorted(tuple(r) for r in query(spark, small, inc.PAGE_EVENTS).collect())
    assert sorted(tuple(r) for r in query(spark, small, 2).collect()) == want
    assert len({r[0] for r in want}) == len(want) > 0
