"""Facts bucketed by order: joins without a shuffle, and a hot order is still split."""

import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from churnlens.operators.model import order_scores, order_value
from churnlens.plans import catalog
from churnlens.sources import binding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["avg_order_value", "gmv_by_status", "score_by_lateness", "score_slope", "review_anomaly", "funnel_nested"])
def test_orders_meet_their_facts_without_a_shuffle(spark, key):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")               # no side is small enough to be sent around
    try:
        plan = E.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    assert "hashpartitioning(order_id" not in plan, plan


@pytest.fixture(scope="module")
def hot_dir(spark):
    """The driver tables, with a third of all lines in one order."""
    d = tempfile.mkdtemp(prefix="hot-orders-")
    for t in ("orders", "customer", "nation", "part", "supplier", "lineitem"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "lineitem":
            df = df.withColumn("l_orderkey", F.when(F.xxhash64(*df.columns) % 3 == 0, F.lit(df.agg(F.min("l_orderkey")).first()[0])).otherwise(F.col("l_orderkey")))
        df.coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return d


def test_a_hot_order_stands_apart(spark, hot_dir):
    t, lazy = binding.model_tables(spark, hot_dir), binding.fixture_tables(spark, hot_dir)
    assert [len(t.by_order(n)) for n in binding.FACTS] == [1, 2, 2]
    cold, hot = t.by_order("order_items")
    assert hot.select("order_id").distinct().count() == 1 and hot.count() > t.order_items.count() / 4
    assert cold.join(hot, "order_id", "left_semi").isEmpty()
    assert t.order_items.exceptAll(lazy.order_items).isEmpty() and t.order_items.count() == lazy.order_items.count()
    for of in (order_value, order_scores):
        assert sorted(map(tuple, of(t).collect())) == sorted(map(tuple, of(lazy).collect()))
    plan = order_value(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan    # the hot order's partial sums


@pytest.mark.parametrize("key", ["gmv_by_status", "score_by_lateness", "review_anomaly", "funnel_timing", "top_categories", "join_fanout"])
def test_queries_over_hot_orders(spark, hot_dir, key, monkeypatch):
    """As over the tables that are neither bucketed nor split."""
    got = catalog.queries()[key](spark, hot_dir).collect()
    monkeypatch.setattr(catalog, "tables", lambda spark, sf_dir: binding.fixture_tables(spark, sf_dir))
    assert got == catalog.queries()[key](spark, hot_dir).collect()
