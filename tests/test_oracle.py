"""Every query of the catalogue against its SQL over the smallest tables."""

import pytest

from offerlens.plans import catalogue
from tests.compare import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(spark, SF, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.count() >= 0 and len(df.columns) == len(set(df.columns))
