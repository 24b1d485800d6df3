"""Cohort, repeat and gap operators on hand-made frames (expected values by hand)."""

from datetime import datetime as dt

from pyspark.sql import functions as F

from churnlens.operators import cohort
from churnlens.operators.model import first_by

SCHEMA = "person string, order_id string, ts timestamp_ntz"


def _m_cohort(spark):
    rows = [
        ("p1", "o1", dt(2017, 1, 31, 23, 0)), ("p1", "o2", dt(2017, 2, 1, 1, 0)),  # month-end / next month
        ("p1", "o3", dt(2017, 4, 3)),                                               # gap month 2 (zero cell)
        ("p2", "o4", dt(2017, 1, 5)), ("p2", "o5", dt(2017, 1, 20)),                # same month twice
        ("p3", "o6", dt(2017, 2, 10)), ("p3", "o7", None),                          # null ts ignored
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_cohort_grid_sparse(spark):
    g = cohort.cohort_retention(_m_cohort(spark), "person", "ts").collect()
    cells = {(r.cohort_month.isoformat(), r.month_index): (r.cohort_size, r.active_customers, r.pct_retained,
                                                            r.is_observable) for r in g}
    assert cells == {
        ("2017-01-01", 0): (2, 2, 100.0, 1),
        ("2017-01-01", 1): (2, 1, 50.0, 1),
        ("2017-01-01", 3): (2, 1, 50.0, 1),
        ("2017-02-01", 0): (1, 1, 100.0, 1),
    }


def test_dense_grid_adds_zeros_and_flags_future(spark):
    dense = cohort.cohort_retention(_m_cohort(spark), "person", "ts", max_index=3, dense=True).collect()
    d = {(r.cohort_month.isoformat(), r.month_index): (r.active_customers, r.is_observable) for r in dense}
    assert d[("2017-01-01", 2)] == (0, 1)  # a real zero: observable
    assert d[("2017-02-01", 2)] == (0, 1)  # 2017-04 is the last month with data
    assert d[("2017-02-01", 3)] == (0, 0)  # beyond the data: not observable
    sparse = cohort.cohort_retention(_m_cohort(spark), "person", "ts", max_index=3).collect()
    nonzero = {k for k, v in d.items() if v[0] > 0}
    assert nonzero == {(r.cohort_month.isoformat(), r.month_index) for r in sparse}


def test_two_customer_ids_one_person(spark):
    # identity resolution happens upstream; one person id -> one cohort member
    df = spark.createDataFrame([("p", "a", dt(2017, 3, 1)), ("p", "b", dt(2017, 3, 2))], SCHEMA)
    g = cohort.cohort_retention(df, "person", "ts").collect()
    assert [(r.cohort_size, r.active_customers) for r in g] == [(1, 1)]


def test_gap_stats_lower_median_and_truncation(spark):
    rows = [
        ("a", "1", dt(2017, 1, 1, 0, 0)), ("a", "2", dt(2017, 1, 1, 23, 59)),  # 23h59 -> 0 days
        ("a", "3", dt(2017, 1, 11, 0, 0)),                                     # 9 days (from 23:59)
        ("b", "4", dt(2017, 1, 1)), ("b", "5", dt(2017, 1, 1)),                # tied ts -> 0
        ("b", "6", dt(2017, 1, 5)),                                            # 4
        ("c", "7", None), ("c", "8", dt(2017, 2, 1)), ("c", "9", dt(2017, 2, 3)),  # null ts; 2
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    r = cohort.gap_stats(df, "person", "ts", "order_id", median="lower").first()
    # gaps: 0, 9, 0, 4, 2 -> n 5, sorted 0 0 2 4 9, median 2, mean 3.0
    assert (r.repeat_purchase_events, r.median_days_between, r.mean_days_between) == (5, 2.0, 3.0)
    df2 = df.filter(F.col("order_id") != "9")  # gaps 0, 9, 0, 4 -> even n: lower middle 0, mid 2.0
    assert cohort.gap_stats(df2, "person", "ts", "order_id", "lower").first().median_days_between == 0.0
    assert cohort.gap_stats(df2, "person", "ts", "order_id", "mid").first().median_days_between == 2.0


def test_repeat_rate_and_histogram(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "2"), ("b", "3"), ("c", "4")],
                               "person string, order_id string")
    r = cohort.repeat_rate(df, distinct=True).first()
    assert (r.customers, r.repeaters, r.repeat_rate_pct) == (3, 1, 33.33)
    h = cohort.frequency_histogram(df).collect()
    assert [(x.orders_per_person, x.people) for x in h] == [(1, 2), (3, 1)]


def test_first_by_nulls_first_and_tie_break(spark):
    rows = [("p", "2", dt(2017, 1, 1)), ("p", "1", dt(2017, 1, 1)), ("q", "9", None), ("q", "3", dt(2016, 1, 1))]
    f = first_by(spark.createDataFrame(rows, SCHEMA), "person", ["ts", "order_id"], []).collect()
    got = {r.person: r.order_id for r in f}
    assert got == {"p": "1", "q": "9"}  # ties by order id; NULL time sorts first, as in SQL


def test_fair_window(spark):
    rows = [("a", "1", dt(2017, 1, 5)), ("a", "2", dt(2017, 3, 5)),   # returned in month 2
            ("b", "3", dt(2017, 1, 9)), ("b", "4", dt(2017, 6, 1)),    # returned in month 5 only
            ("c", "5", dt(2017, 5, 1)),                                # cohort 2017-05: not eligible
            ("d", "6", dt(2017, 2, 1))]
    df = spark.createDataFrame(rows, SCHEMA)
    dims = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "X"), ("d", "Y")], "person string, dim string")
    out = {r.dim: (r.customers, r.repeaters, r.repeat_rate_pct)
           for r in cohort.fair_window_repeat(df, dims, "person", "ts", (1, 3)).collect()}
    # last month 2017-06 -> eligible cohorts up to 2017-03
    assert out == {"X": (2, 1, 50.0), "Y": (1, 0, 0.0)}


def _hot_person_orders(spark):
    # one person places a third of all orders, spread over many months
    rows = []
    for i in range(1200):
        person = "hot" if i % 3 == 0 else f"p{i % 97}"
        rows.append((person, f"o{i:05d}", dt(2016 + (i * 7) % 3, 1 + (i * 5) % 12, 1 + i % 28)))
    return rows, spark.createDataFrame(rows, SCHEMA)


def _months(d):
    return d.year * 12 + d.month - 1


def test_cohort_grid_with_a_hot_person_matches_brute_force(spark):
    rows, df = _hot_person_orders(spark)
    active: dict[str, set] = {}
    for p, _, t in rows:
        active.setdefault(p, set()).add(_months(t))
    cells: dict[tuple, int] = {}
    for months in active.values():
        c = min(months)
        for m in months:
            if m - c <= 12:
                cells[(c, m - c)] = cells.get((c, m - c), 0) + 1
    got = {(_months(r.cohort_month), r.month_index): r.active_customers
           for r in cohort.cohort_retention(df, "person", "ts").collect()}
    assert got == cells


def test_fair_window_with_a_hot_person_matches_brute_force(spark):
    rows, df = _hot_person_orders(spark)
    active: dict[str, set] = {}
    for p, _, t in rows:
        active.setdefault(p, set()).add(_months(t))
    last = max(max(m) for m in active.values())
    eligible = {p: any(1 <= m - min(ms) <= 3 for m in ms) for p, ms in active.items() if min(ms) <= last - 3}
    dims = spark.createDataFrame([(p, "hot" if p == "hot" else "rest") for p in active], "person string, dim string")
    out = {r.dim: (r.customers, r.repeaters) for r in cohort.fair_window_repeat(df, dims, "person", "ts").collect()}
    want: dict[str, list] = {}
    for p, returned in eligible.items():
        d = "hot" if p == "hot" else "rest"
        want.setdefault(d, [0, 0])
        want[d][0] += 1
        want[d][1] += int(returned)
    assert out == {k: tuple(v) for k, v in want.items()}


def test_repeat_by_first_one_aggregate_equals_separate_totals(spark):
    rows = [("p1", "o1", dt(2017, 1, 1), dt(2017, 1, 5), dt(2017, 1, 10)),   # on time, repeats
            ("p1", "o2", dt(2017, 2, 1), None, None),
            ("p2", "o3", dt(2017, 1, 2), dt(2017, 1, 20), dt(2017, 1, 10)),  # late, single
            ("p3", "o4", dt(2017, 1, 3), None, dt(2017, 1, 10)),             # never delivered, repeats
            ("p3", "o5", dt(2017, 3, 1), dt(2017, 3, 2), dt(2017, 3, 9)),
            ("p4", "o6", dt(2017, 1, 4), dt(2017, 1, 6), dt(2017, 1, 10))]   # on time, single
    df = spark.createDataFrame(rows, "person string, order_id string, ts timestamp_ntz, "
                                     "delivered_at timestamp_ntz, estimated_at timestamp_ntz")
    cls = ("CASE WHEN delivered_at IS NULL THEN 'never' WHEN delivered_at > estimated_at THEN 'late' "
           "ELSE 'on time' END")
    payload = ("delivered_at", "estimated_at")
    want = {"never": (1, 100.0), "late": (1, 0.0), "on time": (2, 50.0)}
    one = cohort.repeat_by_first(df, None, cls, "person", "ts", "order_id", payload).collect()
    assert {r["class"]: (r.customers, r.repeat_rate_pct) for r in one} == want
    totals = df.groupBy("person").agg(F.countDistinct("order_id").alias("n_orders"))
    two = cohort.repeat_by_first(df, totals, cls, "person", "ts", "order_id", payload).collect()
    assert {r["class"]: (r.customers, r.repeat_rate_pct) for r in two} == want


def test_mean_order_value_leaves_out_null_revenue(spark):
    orders = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "order_id string")
    values = spark.createDataFrame([("a", "10.00"), ("b", "20.00"), ("c", None)], "order_id string, v string") \
        .select("order_id", F.col("v").cast("decimal(10,2)").alias("order_revenue"))
    r = cohort.avg_order_value(orders, values).first()
    assert (r.avg_order_value_brl, r.orders) == (15.0, 3)


def test_fair_window_reads_the_orders_once(spark):
    rows = [("p1", "o1", dt(2017, 1, 5)), ("p1", "o2", dt(2017, 3, 5)), ("p2", "o3", dt(2017, 1, 9)),
            ("p3", "o4", dt(2017, 6, 1)), ("p4", "o5", dt(2017, 7, 1))]
    act = spark.createDataFrame(rows, SCHEMA)
    dims = spark.createDataFrame([("p1", "x"), ("p2", "x"), ("p3", "y"), ("p5", None)], "person string, dim string")
    got = cohort.fair_window_repeat(act, dims, "person", "ts")
    # p4 has no dimension, but its month (July) is the last one: cohorts up to April count
    assert [tuple(r) for r in got.collect()] == [("x", 2, 1, 50.0)]
    fixed = cohort.fair_window_repeat(act, dims, "person", "ts", eligible_from="2017-06-01", eligible_to="2017-06-01")
    assert [tuple(r) for r in fixed.collect()] == [("y", 1, 0, 0.0)]


def test_clips_cut(spark):
    grid = cohort.cohort_retention(_m_cohort(spark), "person", "ts", clip=("2017-02-01", "2017-02-01"))
    assert {r.cohort_month.isoformat() for r in grid.collect()} == {"2017-02-01"}
    rev = cohort.revenue_retention(_m_cohort(spark).withColumn("rev", F.lit(1).cast("decimal(10,2)")), "person", "ts", "rev",
                                   clip=("2017-01-01", "2017-01-01"))
    assert {r.cohort_month.isoformat() for r in rev.collect()} == {"2017-01-01"}
