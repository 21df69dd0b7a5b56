"""Plan guards: no registered query plans a cross product or a nested-loop
join, and filters / projections reach the Parquet scan where they should."""

import pytest

from __spark_entry__ import queries
from pagewright.plans.catalog import QUERIES as CATALOG

SF = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in queries().items() if k in CATALOG}


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_products(spark, name):
    p = plan_text(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_retention_filter_is_pushed_to_the_scan(spark):
    p = plan_text(QUERIES["retention_window"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p


def test_scans_read_only_needed_columns(spark):
    p = plan_text(QUERIES["document_admission"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in p
    p = plan_text(QUERIES["metric_summary"](spark, SF))
    assert "props" not in p
