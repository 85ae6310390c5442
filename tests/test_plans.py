"""What the optimizer makes of the rules."""

import pytest

from checks import catalogue
from checks.registry import P
from checks.views import tables

from spendwarden.plans import duplicates, network

RELATIONAL = [k for k in catalogue.QUERIES if k[:3] in ("d01", "d02", "d04", "d05", "d11", "d12", "d13", "d14", "d16", "d18", "d32", "d33", "d35", "d36", "d37")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", RELATIONAL)
def test_no_cross_or_nested_loop_joins_and_no_python(spark, sf, key):
    text = plan(catalogue.QUERIES[key](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path, sf):
    path = str(tmp_path / "payment")
    tables(spark, sf, "payment")["payment"].write.parquet(path)
    t = {"payment": spark.read.parquet(path), "vendor": tables(spark, sf, "vendor")["vendor"]}
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    text = duplicates.near_duplicates(t, P)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line and "payment_date" in line)
    assert "GreaterThanOrEqual(amount,5000" in scan and "IsNotNull(payment_date)" in scan
    assert "agency_id" not in scan.split("ReadSchema")[1]


def test_days_are_counted_before_the_window(spark, sf):
    text = plan(duplicates.near_duplicates(tables(spark, sf, "payment", "vendor"), P))
    assert "partial_count" in text and text.index("Window") < text.rindex("partial_count")


def test_hub_limits_need_no_cross_join(spark, sf):
    t = tables(spark, sf, "payment", "contract", "vendor", "agency")
    text = plan(network.hub_vendors(t, P, network.spending_edges(t)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
