"""Every query of the catalogue against its SQL, on the smallest tables."""

import pytest

from spanloom.plans import catalogue
from tests.parity import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    more, fewer = same(spark, SF, catalogue.QUERIES[name], catalogue.SQL[name])
    assert not more and not fewer, (name, list(more)[:3], list(fewer)[:3])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_parity_harness_sees_a_wrong_query(spark):
    more, fewer = same(spark, SF, lambda s, d: s.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey + 1 AS k"), "SELECT n_nationkey AS k FROM nation")
    assert more and fewer


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
