"""Nested funnel, stage timing and lateness operators on hand-made frames."""

import random
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from churnlens.functions.dates import whole_days
from churnlens.operators import funnel

SCHEMA = "order_id string, t0 timestamp_ntz, t1 timestamp_ntz, t2 timestamp_ntz"


def test_nested_funnel_and_metrics(spark):
    rows = [("a", dt(2017, 1, 1), dt(2017, 1, 1, 1), dt(2017, 1, 2)),
            ("b", dt(2017, 1, 1), None, dt(2017, 1, 3)),            # null in the middle: stops at stage 1
            ("c", dt(2017, 1, 1), dt(2017, 1, 1, 2), None),
            ("d", dt(2017, 1, 1), dt(2016, 12, 31), None)]          # stage out of order still counts
    df = spark.createDataFrame(rows, SCHEMA)
    out = funnel.funnel(df, [("placed", None), ("one", "t1"), ("two", "t2")]).collect()
    assert [(r.stage, r.orders, r.pct_of_placed, r.step_conversion_pct, r.dropped_here) for r in out] == [
        ("placed", 4, 100.0, None, None), ("one", 3, 75.0, 75.0, 1), ("two", 1, 25.0, 33.33, 2)]


def test_timing_drops_negative_and_missing(spark):
    rows = [("a", dt(2017, 1, 1), dt(2017, 1, 1, 1), None),
            ("b", dt(2017, 1, 1), dt(2017, 1, 1, 3), None),
            ("c", dt(2017, 1, 1), dt(2016, 12, 31), None),         # negative: dropped
            ("d", dt(2017, 1, 1), None, None)]                     # missing: dropped
    df = spark.createDataFrame(rows, SCHEMA)
    r = funnel.funnel_timing(df, [("0 -> 1", "t0", "t1")]).first()
    # minutes 60 and 180: median 120 min = 2.0 h, p90 = 180 min
    assert (r.n_orders, r.median_hours, r.median_days, r.mean_days, r.p90_days) == (2, 2.0, 0.08, 0.08, 0.13)


def test_single_row_timing(spark):
    df = spark.createDataFrame([("a", dt(2017, 1, 1), dt(2017, 1, 2), None)], SCHEMA)
    r = funnel.funnel_timing(df, [("0 -> 1", "t0", "t1")]).first()
    assert (r.n_orders, r.median_days, r.p90_days) == (1, 1.0, 1.0)


def test_funnel_over_time(spark):
    rows = [("a", dt(2017, 1, 1), dt(2017, 1, 2), dt(2017, 1, 5)),
            ("b", dt(2017, 1, 9), None, dt(2017, 1, 10)),
            ("c", dt(2017, 2, 1), dt(2017, 2, 1), None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", f"{whole_days('t0', 't2')} AS days")
    out = funnel.funnel_over_time(df, "t0", [("pct_one", "t1"), ("pct_two", "t2")], "days").collect()
    assert [(r.month.isoformat(), r.placed, r.pct_one, r.pct_two, r.avg_days_to_deliver) for r in out] == [
        ("2017-01-01", 2, 50.0, 50.0, 2.5), ("2017-02-01", 1, 100.0, 0.0, None)]


def test_funnel_over_time_other_grains(spark):
    rows = [("a", dt(2017, 1, 1), dt(2017, 1, 2), dt(2017, 1, 5)),
            ("b", dt(2017, 1, 9), None, dt(2017, 1, 10)),
            ("c", dt(2017, 2, 1), dt(2017, 2, 1), None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", f"{whole_days('t0', 't2')} AS days")
    stages = [("pct_one", "t1"), ("pct_two", "t2")]
    year = funnel.funnel_over_time(df, "t0", stages, "days", grain="year").collect()
    assert [(r.year.isoformat(), r.placed, r.pct_one, r.pct_two, r.avg_days_to_deliver) for r in year] == [
        ("2017-01-01", 3, 66.67, 33.33, 2.5)]
    week = funnel.funnel_over_time(df, "t0", stages, "days", grain="week").collect()
    assert [(r.week.isoformat(), r.placed) for r in week] == [
        ("2016-12-26", 1), ("2017-01-09", 1), ("2017-01-30", 1)]  # weeks start on Monday


def test_least_squares_slope_range_constant_x_and_one_row(spark):
    u = 1_000_000
    df = spark.createDataFrame([(0, 5 * u), (1, 4 * u), (2, 3 * u), (100, 1 * u)], "x int, y bigint")
    r = funnel.least_squares_slope(df, "x", "y", (-30, 60)).first()
    assert (r.n, r.slope, r.mean_y) == (3, -1.0, 4.0)  # x = 100 is outside the range
    const = spark.createDataFrame([(5, 1 * u), (5, 3 * u)], "x int, y bigint")
    r = funnel.least_squares_slope(const, "x", "y").first()
    assert (r.n, r.slope, r.mean_y) == (2, None, 2.0)
    one = funnel.least_squares_slope(df.limit(1), "x", "y").first()
    assert one.n == 1 and one.slope is None


def test_quantiles_of_value_counts(spark):
    from churnlens.operators import present
    rows = [("a", v) for v in (5, 1, 1, 2)] + [("b", 7), ("c", None)] + [(None, v) for v in range(1, 11)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r.k: (r.n, r.median, r.low_median, r.p90, r.total) for r in funnel.value_quantiles(df, ["k"], "v").collect()}
    assert got == {"a": (4, 1.5, 1.0, 5.0, 9), "b": (1, 7.0, 7.0, 7.0, 7), None: (10, 5.5, 5.0, 9.0, 55)}
    empty = funnel.value_quantiles(df.limit(0), [], "v").first()
    assert (empty.n, empty.median, empty.total) == (0, None, None)
    cells = spark.createDataFrame([("2017-01-01", 100000, i, n, 1) for i, n in ((0, 100000), (1, 1346))],
                                  "cohort_month string, cohort_size long, month_index long, active_customers long, is_observable long")
    r = present.heatmap_scale(cells).first()
    assert (r.scale_max, r.mean_month1_pct, r.cohorts_with_month1) == (1.346, 1.346, 1)


@pytest.mark.parametrize("bits", [12, 24, 60])
def test_quantiles_do_not_depend_on_the_steps(spark, bits):
    """Wide, negative, tied and lone values against sorted lists, with and without groups."""
    rng = random.Random(bits)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.randint(-2 ** 40, 2 ** 40), rng.randint(0, 5000), 4095, 4096, -1]), rng.random() < 0.3) for _ in range(900)]
    rows += [("one", 2 ** 50, True), ("none", None, True)]
    df = spark.createDataFrame(rows, "k string, v long, f boolean")

    def want(of):
        vs, n = sorted(v for v, _ in of), len(of)
        return n, (vs[(n + 1) // 2 - 1] + vs[(n + 2) // 2 - 1]) / 2, float(vs[(n + 1) // 2 - 1]), float(vs[-(-9 * n // 10) - 1]), sum(vs), sum(f for _, f in of)

    got = {r.k: (r.n, r.median, r.low_median, r.p90, r.total, r.flagged) for r in funnel.value_quantiles(df, ["k"], "v", "f", bits).collect()}
    assert got == {k: want([(v, f) for x, v, f in rows if x == k]) for k in ("a", "b", None, "one")}
    r = funnel.value_quantiles(df, [], "v", "f", bits).first()
    assert (r.n, r.median, r.low_median, r.p90, r.total, r.flagged) == want([(v, f) for _, v, f in rows if v is not None])
    empty = funnel.value_quantiles(df.limit(0), [], "v", "f", bits).collect()
    assert [(e.n, e.median, e.total) for e in empty] == [(0, None, None)]
    assert funnel.value_quantiles(df.limit(0), ["k"], "v", "f", bits).count() == 0


def test_wide_quantiles_order_only_cells(spark):
    """A group with 2^16 different values: no window, and at most 2^12 counts of it in one list."""
    df = spark.range(1 << 16).select((F.col("id") * 3).alias("v"))
    q = funnel.value_quantiles(df, [], "v")
    assert "Window" not in q._jdf.queryExecution().executedPlan().toString()
    r = q.first()
    assert (r.n, r.low_median, r.p90) == (1 << 16, 3.0 * ((1 << 15) - 1), 3.0 * (-(-9 * (1 << 16) // 10) - 1))
