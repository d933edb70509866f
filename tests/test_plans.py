"""What plans must not do twice."""

import re

import pytest

from remarkt.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "scans", "exchanges"), [("etl_price_history", 2, 9), ("counterfactual", 1, 1), ("price_history_merge", 2, 4)])
def test_each_input_is_read_once(spark, name, scans, exchanges):
    """With no side small enough to be sent: as many scans as inputs, and few shuffles."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall("FileScan", plan)) <= scans and len(re.findall("Exchange hashpartitioning", plan)) <= exchanges, plan
