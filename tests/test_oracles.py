"""Every registered query against its SQL on the given tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import differences, duck
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql())


def test_entry_gives_alerts(spark):
    alerts = entry(spark)
    assert {"url", "subject", "body"} <= set(alerts.columns)
    assert alerts.count() > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, name):
    left, right, only_spark, only_sql = differences(spark, duck(SF), queries()[name], oracle_sql()[name], SF)
    assert not only_spark and not only_sql
    assert left == right > 0
