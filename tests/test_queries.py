"""Every registered query of the library against its SQL, and under another order of rows."""

import pytest

import __spark_entry__ as entry
from tests.compare import same
from trackweave import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, plans.queries()[name], plans.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["line_id", "on_time", "median", "p90", "n", "cancelled", "cancel_rate"]


def test_names_are_unique():
    groups = [set(__import__(f"trackweave.plans.{g}", fromlist=["QUERIES"]).QUERIES) for g in plans.GROUPS]
    assert sum(map(len, groups)) == len(plans.queries())
    assert set(plans.oracle_sql()) <= set(plans.queries())
