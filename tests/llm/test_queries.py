import os

import pytest

import __spark_entry__
from tests.oracle_compare import connect, rows
from tidewright.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, FOLDER).toPandas()) == rows(connect(FOLDER).execute(queries.SQL[name]).df())


def test_thirteen_operators_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
