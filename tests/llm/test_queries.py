import os

import pytest

from primeloom.llm import queries as Q
from primeloom.llm.reading_level import found
from tests import twins

pytestmark = pytest.mark.skipif(not os.path.isdir(twins.DATA), reason="test tables not here")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert twins.differences(spark, Q.queries()[name], Q.oracle_sql()[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert Q.queries()[name](spark, twins.DATA).count() > 0


def test_levels_agree_with_held_out_grades(spark):
    folder = "/root/testdata/sf0.01"
    docs, grades = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "level_labels"))
    got = {r.doc_id: r.reading_level for r in found(docs, grades.where("doc_id % 2 = 0")).collect()}
    held = [r for r in grades.where("doc_id % 2 = 1 AND reading_level IS NOT NULL").collect() if r.doc_id in got]
    assert sum(got[r.doc_id] == r.reading_level for r in held) >= 0.9 * len(held) > 0
