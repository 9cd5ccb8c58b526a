"""Every registered query with SQL gives the SQL's rows; those without run and give rows."""

import pytest
from oracle import connect, duck_rows, spark_rows

from tessella import plans


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, data, duck, name):
    got, names = spark_rows(plans.QUERIES[name](spark, data))
    want, sql_names = duck_rows(duck, plans.ORACLES[name])
    assert names == sql_names
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert plans.QUERIES[name](spark, data).count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_places_in_a_log_do_not_hang_on_reused_exchanges(spark, duck, data):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got, _ = spark_rows(plans.QUERIES["src_21"](spark, data))
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == duck_rows(duck, plans.ORACLES["src_21"])[0]
