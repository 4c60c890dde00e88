"""Every exposure query against its SQL, and the contract of the entry point."""

import pytest

import __spark_entry__ as entry_point
from sovara.plans import oracle
from sovara.plans import queries as exposure_queries
from tests.compare import rows_of, sql_rows

QUERIES = exposure_queries.queries()


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, small, name):
    assert rows_of(QUERIES[name](spark, small)) == sql_rows(oracle.SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle.SQL)))
def test_query_without_sql_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).columns


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_results_do_not_depend_on_partitions(spark, small):
    from sovara.operators import identity
    from sovara.plans.exposure import exposure

    base = exposure(spark, small)
    one, many = (rows_of(identity.serial_numbers(base.repartition(n)).select("row_index", "LocationID")) for n in (1, 17))
    assert one == many
