"""Ranks by digits equal Spark's single-task window functions."""

import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlens.operators import ranking, rfm, selection
from churnlens.operators.selection import ntiles


def agree(df, tiles, key="person"):
    got = ntiles(df, tiles)
    over = {name: Window.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in order]) for name, (_, order) in tiles.items()}
    want = df.select(key, *[F.ntile(n).over(over[name]).alias(f"{name}_ref") for name, (n, _) in tiles.items()])
    j = got.join(want, key)
    assert j.count() == df.count()
    for name in tiles:
        assert j.filter(F.col(name) != F.col(f"{name}_ref")).count() == 0, name


@pytest.fixture(params=[(32, 3), (1024, 256)])
def passes(request, monkeypatch):
    """Many passes over few cells, and the production values."""
    monkeypatch.setattr(selection, "CELLS", request.param[0])
    monkeypatch.setattr(selection, "FETCHED", request.param[1])


@pytest.mark.parametrize("n_rows", [0, 1, 4, 6, 9, 1000])
def test_matches_builtin(spark, n_rows, passes):
    df = spark.range(n_rows).select(F.col("id").alias("person"), (F.col("id") * 7 % 5).alias("v"), (F.col("id") * 31 % 17 - 8).alias("w"))
    agree(df, {"a": (5, [("v", False), ("person", True)]), "b": (3, [("w", True), ("v", True), ("person", False)])})


def test_a_value_held_by_nearly_all(spark, passes):
    df = spark.range(5003).select(F.col("id").alias("person"), F.when(F.col("id") % 33 == 0, F.col("id")).otherwise(1).alias("v"))
    agree(df, {"t": (5, [("v", True), ("person", True)]), "d": (5, [("v", False), ("person", True)])})


def test_every_type_with_nulls(spark, passes):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        some = lambda v: None if rng.random() < 0.1 else v
        rows.append((i, some(rng.randint(-2 ** 63, 2 ** 63 - 1)), some(date(2000, 1, 1).replace(year=rng.randint(1900, 2100))),
                     some(datetime(2020, 1, rng.randint(1, 28), rng.randint(0, 23), 5, 6, rng.randint(0, 999999))), some(Decimal(rng.randint(-10 ** 6, 10 ** 6)).scaleb(-2)),
                     some(Decimal(rng.randint(-10 ** 30, 10 ** 30)).scaleb(-4)), some("".join(rng.choice("aé b\u0001") for _ in range(rng.randint(0, 20)))), some(rng.random() < 0.5)))
    df = spark.createDataFrame(rows, "person int, l long, d date, t timestamp_ntz, m decimal(10,2), w decimal(34,4), s string, b boolean")
    df = df.withColumn("u", F.col("t").cast("timestamp"))
    agree(df, {f"{c}_{up}": (7, [(c, up), ("person", True)]) for c in ("l", "d", "t", "u", "m", "w", "s", "b") for up in (True, False)})


def test_other_types_are_refused(spark):
    with pytest.raises(TypeError):
        ntiles(spark.range(3).select(F.col("id").cast("double").alias("x")), {"t": (2, [("x", True)])})


def test_neither_sort_nor_shuffle(spark):
    got = ntiles(spark.range(3000).select(F.col("id").alias("person")), {"t": (5, [("person", True)])})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_scores_rank_no_rows(spark, monkeypatch):
    """The scores and the value quintile need no global rank."""
    monkeypatch.setattr(ranking, "global_row_number", None)
    rows = [(f"p{i:04d}", datetime(2018, 1, 1 + i % 20), 1 + (i % 33 == 0), Decimal(f"{10 + (i * 7) % 13}.50")) for i in range(500)]
    base = spark.createDataFrame(rows, "person string, last_order_at timestamp_ntz, frequency bigint, monetary decimal(20,2)")
    scored = rfm.rfm_score(base, spark.createDataFrame([(date(2018, 2, 1),)], "as_of date"))
    ref = base.withColumn("q", F.ntile(5).over(Window.orderBy(F.col("monetary").desc(), "person")))
    assert scored.join(ref, "person").filter("q <> value_quintile").count() == 0
    assert rfm.pareto(scored).collect() == rfm.pareto(scored.drop("value_quintile")).collect()
