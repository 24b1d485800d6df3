"""Profiling operators on hand-made frames: join fan-out counts and key checks."""

from datetime import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

from churnlens.operators import cohort, profile
from churnlens.sources import csv


def _chain(spark):
    persons = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "person string")
    customers = spark.createDataFrame(  # p1 has two customer ids, p3 none (lost)
        [("p1", "c1"), ("p1", "c2"), ("p2", "c3"), ("p9", "c9")], "person string, customer_id string")
    orders = spark.createDataFrame(
        [("c1", "o1"), ("c2", "o2"), ("c3", "o3"), ("c3", "o4")], "customer_id string, order_id string")
    items = spark.createDataFrame(  # o1 fans out to three lines; o4 has none
        [("o1", "a"), ("o1", "a"), ("o1", "b"), ("o2", "b"), ("o3", "z")], "order_id string, product_id string")
    products = spark.createDataFrame([("a",), ("b",)], "product_id string")  # z is unknown
    return persons, customers, orders, items, products


def test_fanout_matches_materialised_joins(spark):
    persons, customers, orders, items, products = _chain(spark)
    steps = [("customers", customers, "person", "customer_id"), ("orders", orders, "customer_id", "order_id"),
             ("order_items", items, "order_id", "product_id"), ("products", products, "product_id", None)]
    got = [(r.stage, r.rows) for r in profile.fanout(persons, "person", steps, "persons").collect()]
    j1 = persons.join(customers, "person")
    j2 = j1.join(orders, "customer_id")
    j3 = j2.join(items, "order_id")
    j4 = j3.join(products, "product_id")
    assert got == [("persons", 3), ("customers", j1.count()), ("orders", j2.count()),
                   ("order_items", j3.count()), ("products", j4.count())]
    assert [n for _, n in got] == [3, 3, 4, 5, 4]


def test_check_key_counts_duplicates_and_nulls(spark):
    df = spark.createDataFrame([("o1", 1), ("o1", 1), ("o1", 2), ("o2", None), (None, 1), ("o3", 1)],
                               "order_id string, order_item_id int")
    r = csv.check_key(df, ["order_id", "order_item_id"], "order_items").first()
    assert (r.rows, r.distinct_keys, r.null_keys, r.duplicated_keys, r.is_primary_key) == (6, 3, 2, 1, False)
    ok = csv.check_key(df.filter("order_id = 'o3'"), ["order_id"], "orders").first()
    assert ok.is_primary_key and ok.rows == 1


def test_gap_stats_with_a_hot_person_matches_brute_force(spark):
    # one person holds a third of all orders; gaps must equal a per-person sort
    rows = []
    for i in range(900):
        person = "hot" if i % 3 == 0 else f"p{i % 40}"
        rows.append((person, f"o{i:04d}", dt(2017, 1, 1 + (i * 7) % 28, (i * 5) % 24)))
    df = spark.createDataFrame(rows, "person string, order_id string, ts timestamp_ntz")
    got = cohort.gap_stats(df, "person", "ts", "order_id", median="lower").first()
    by_person: dict[str, list] = {}
    for p, o, t in rows:
        by_person.setdefault(p, []).append((t, o))
    gaps = []
    for seq in by_person.values():
        seq.sort()
        gaps += [int((b[0] - a[0]).total_seconds() // 86400) for a, b in zip(seq, seq[1:])]
    gaps.sort()
    assert got.repeat_purchase_events == len(gaps)
    assert got.median_days_between == float(gaps[(len(gaps) + 1) // 2 - 1])
    mean = (Decimal(sum(gaps)) / Decimal(len(gaps))).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)
    assert got.median_days_between is not None and got.mean_days_between == float(mean)


def test_fanout_reports_zero_for_a_step_that_loses_every_row(spark):
    persons, customers, orders, _, _ = _chain(spark)
    nobody = spark.createDataFrame([("c7", "o7")], "customer_id string, order_id string")
    steps = [("customers", customers, "person", "customer_id"), ("orders", nobody, "customer_id", "order_id"),
             ("items", orders.select("order_id"), "order_id", None)]
    got = [(r.step_no, r.stage, r.rows) for r in profile.fanout(persons, "person", steps, "persons").collect()]
    assert got == [(1, "persons", 3), (2, "customers", 3), (3, "orders", 0), (4, "items", 0)]
