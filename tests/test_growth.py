import pytest

from bibspark.operators import people
from bibspark.plans import queries
from bibspark.schemas import AUTHOR

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["summary_counts", "share_of_works"])
def test_resolutions_are_derived_once(spark, name):
    """People and counters read stored resolutions; lineitem isn't joined and sorted again for each."""
    assert "l_orderkey" not in plan(queries.QUERIES[name](spark, FOLDER))[0]


def test_credits_are_dealt_once(spark):
    rows = spark.createDataFrame([], f"bib_id long, index int, pos int, work_key string, key string, author {AUTHOR}")
    assert plan(people.credited(rows))[1].count("Exchange hashpartitioning") == 1


def test_lines_of_orders_with_works_are_gathered(spark):
    """Only orders with a work have authors, so no other order's lines are gathered."""
    assert "LeftSemi" in plan(queries.derived_authors(spark, FOLDER))[0]
