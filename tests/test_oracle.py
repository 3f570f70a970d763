"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as spark_entry
import check
from marquee.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
# On the smallest tables every group has an event.
LARGER = {"groups_without_events": "/root/testdata/sf0.01"}
QUERIES, SQL = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def cons():
    return {d: check.connect(d) for d in (SF_DIR, *LARGER.values())}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, cons, name):
    sf_dir = LARGER.get(name, SF_DIR)
    ok, rows, why = check.compare(spark, cons[sf_dir], name, QUERIES[name], SQL.get(name), sf_dir)
    assert ok is not False, why
    assert rows > 0


def test_entry_has_rows(spark):
    assert spark_entry.entry(spark).count() > 0
