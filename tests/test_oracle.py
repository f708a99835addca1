"""Every registered query against its SQL twin on the smallest data set.

Plans are checked on the way: no Cartesian product or nested-loop join may appear.
"""

import os

import pytest

from boardlake.plans import load
from boardlake.plans.catalog import QUERIES
from tools.check_oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
load()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not mounted")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    df = q.run(spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    got = df.toPandas()
    if q.sql is not None:
        assert compare(got, con.execute(q.sql).df()) is None
