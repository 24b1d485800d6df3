"""Plan checks: single scans, no single-task work on person-level rows, pruned reads."""

import glob
import os
import re
import tempfile

import pytest

import __spark_entry__ as E
from churnlens.sources import sinks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _executed(df) -> str:
    """The final (adaptive) physical plan after running the query."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("key", ["funnel_nested", "funnel_timing", "funnel_by_month"])
def test_funnels_scan_orders_once(spark, key):
    plan = _executed(E.queries()[key](spark, SF))
    scans = [x for x in plan.split("\n") if "FileScan" in x and "order_purchase_timestamp" in x]
    assert len(scans) == 1, plan


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


PASS_THROUGH = ("Project", "Filter", "AQEShuffleRead", "ShuffleQueryStage", "Sort", "InputAdapter",
                "WholeStageCodegen")


def _single_partition_only_on_small_inputs(plan: str) -> bool:
    """Every single-partition exchange feeds a broadcast (<= P offset rows) or
    reads an aggregated result (a handful of groups), never raw person rows."""
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        ind = _indent(line)
        if any("BroadcastExchange" in x and _indent(x) < ind for x in lines[:i]):
            continue
        child = next((x.strip(" :+-*()0123456789") for x in lines[i + 1:]
                      if _indent(x) > ind and not x.strip(" :+-*()0123456789").startswith(PASS_THROUGH)), "")
        if not child.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate")):
            return False
    return True


@pytest.mark.parametrize("key", ["rfm_customers", "pareto", "repeat_gap"])
def test_ranked_queries_have_no_single_task_on_rows(spark, key):
    df = E.queries()[key](spark, SF)
    assert _single_partition_only_on_small_inputs(_executed(df))


def test_scan_reads_only_needed_columns(spark):
    df = E.queries()["date_bounds"](spark, SF)
    plan = _executed(df)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all(s == "order_purchase_timestamp:timestamp_ntz" for s in schemas), schemas


def test_export_csv_writes_null_text(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="export-"), "res")
    df = spark.createDataFrame([("1. Placed", 10, None), ("2. Approved", 9, 90.0)],
                               "stage string, orders bigint, step_conversion_pct double")
    sinks.export_csv(df.coalesce(1), out)
    text = "".join(open(f).read() for f in glob.glob(os.path.join(out, "part-*.csv")))
    assert "stage,orders,step_conversion_pct" in text and "1. Placed,10,NULL" in text


# Operators that keep the row count of an aggregated result (or only narrow it).
ABOVE_AGGREGATE = PASS_THROUGH + ("Window", "Exchange hashpartitioning", "Generate", "Union")


@pytest.mark.parametrize("key", sorted(E.queries()))
def test_no_cartesian_and_no_single_task_on_rows(spark, key):
    """No registered query pairs rows without a key (cartesian / nested-loop joins;
    one-row values are scalar subqueries), and every single-partition exchange
    reads an aggregated result, never raw rows."""
    plan = E.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, plan
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        ind = _indent(line)
        child = next((x.strip(" :+-*()0123456789") for x in lines[i + 1:]
                      if _indent(x) > ind and not x.strip(" :+-*()0123456789").startswith(ABOVE_AGGREGATE)), "")
        assert child.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate")), (key, plan)


@pytest.mark.parametrize("key", ["repeat_gap", "funnel_timing", "delivery_by_state", "delivery_time"])
def test_quantiles_never_aggregate_rows(spark, key):
    """Exact quantiles come from counts per value; no percentile buffer is built from rows."""
    assert "percentile" not in E.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_fair_window_scans_once(spark):
    plan = E.queries()["matched_window_by_year"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2                       # orders and customers
