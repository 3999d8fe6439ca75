import os

import pytest

import __spark_entry__ as entry
from primeloom import queries as core
from tests import twins

pytestmark = pytest.mark.skipif(not os.path.isdir(twins.DATA), reason="test tables not here")


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert twins.differences(spark, core.queries()[name], core.oracle_sql()[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert core.queries()[name](spark, twins.DATA).count() > 0


def test_entry_has_a_row_per_model(spark):
    df = entry.entry(spark)
    assert df.count() == df.select("model").distinct().count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
