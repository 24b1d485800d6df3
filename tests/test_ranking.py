"""The distributed global rank equals Spark's single-partition window functions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlens.operators.ranking import global_row_number, number_in_group, previous_in_group, split_hot_groups


def test_row_number_is_a_permutation(spark):
    df = spark.range(2000).select(((F.col("id") * 7919) % 2000).alias("k"))
    rn = global_row_number(df, [F.col("k")], "rn", total="n", num_partitions=6)
    rows = rn.collect()
    assert sorted(r.rn for r in rows) == list(range(1, 2001))
    assert all(r.rn == r.k + 1 and r.n == 2000 for r in rows)


def test_rank_plan_reads_stored_rows_and_broadcasts_offsets(spark):
    df = spark.range(500).select(F.col("id").alias("person"), (F.col("id") % 3).alias("v"))
    got = global_row_number(df, [F.col("v"), F.col("person")], "rn", "n", 4)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "FileScan parquet" in plan and "BroadcastHashJoin" in plan
    # the only single-partition exchange feeds the broadcast side (<= P offset rows)
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            indent = len(line) - len(line.lstrip(" :+-"))
            above = [x for x in lines[:i] if "BroadcastExchange" in x]
            assert above and len(above[-1]) - len(above[-1].lstrip(" :+-")) < indent


def test_previous_in_group_matches_lag(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("g"), ((F.col("id") * 31) % 1000).alias("t"),
                                  F.col("id").alias("tie"))
    # one hot group holding a third of the rows
    df = df.withColumn("g", F.when(F.col("tie") % 3 == 0, F.lit(99)).otherwise(F.col("g")))
    got = previous_in_group(df, "g", ["t", "tie"], "t", "prev", 5)
    ref = df.withColumn("prev_ref", F.lag("t").over(Window.partitionBy("g").orderBy("t", "tie")))
    assert got.join(ref, "tie").filter(~F.col("prev").eqNullSafe(F.col("prev_ref"))).count() == 0


def _hot_and_cold(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("g"), ((F.col("id") * 31) % 1000).alias("t"),
                                  F.col("id").alias("tie"))
    # one hot group holding a third of the rows; the other groups are cold
    return df.withColumn("g", F.when(F.col("tie") % 3 == 0, F.lit(99)).otherwise(F.col("g")))


def test_split_hot_groups_takes_only_groups_above_an_average_partition(spark):
    cold, hot = split_hot_groups(_hot_and_cold(spark), "g", 5)
    assert [r.g for r in hot.select("g").distinct().collect()] == [99]
    assert hot.count() == 1000 and cold.count() == 2000
    assert cold.filter("g = 99").count() == 0


def test_split_hot_groups_plans_no_hot_path_without_hot_groups(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("g"))
    cold, hot = split_hot_groups(df, "g", 5)
    assert hot is None and cold is df


def test_number_in_group_without_hot_groups_is_the_window(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("g"), F.col("id").alias("t"))
    got = number_in_group(df, "g", [F.col("t")], "rn", 5)
    ref = df.withColumn("rn_ref", F.row_number().over(Window.partitionBy("g").orderBy("t")))
    assert got.join(ref, "t").filter(F.col("rn") != F.col("rn_ref")).count() == 0


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_number_in_group_matches_row_number(spark, parts):
    df = _hot_and_cold(spark)
    got = number_in_group(df, "g", [F.col("t"), F.col("tie")], "rn", parts)
    ref = df.withColumn("rn_ref", F.row_number().over(Window.partitionBy("g").orderBy("t", "tie")))
    assert got.count() == 3000
    assert got.join(ref, "tie").filter(F.col("rn") != F.col("rn_ref")).count() == 0


def test_a_hot_null_group_is_split(spark):
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("g"),
                                 F.col("id").alias("t"))                       # a third of all rows has no group
    cold, hot = split_hot_groups(df, "g", 8)
    assert hot.count() == 100 and hot.filter("g is not null").count() == 0 and cold.count() == 200
    ref = df.withColumn("rn_ref", F.row_number().over(Window.partitionBy("g").orderBy("t"))) \
        .withColumn("prev_ref", F.lag("t").over(Window.partitionBy("g").orderBy("t")))
    numbered = number_in_group(df, "g", [F.col("t")], "rn", 8)
    before = previous_in_group(df, "g", ["t"], "t", "prev", 8)
    assert numbered.count() == before.count() == 300
    assert numbered.join(ref, "t").filter("rn <> rn_ref").count() == 0
    assert before.select("t", "prev").join(ref, "t").filter("not (prev <=> prev_ref)").count() == 0
