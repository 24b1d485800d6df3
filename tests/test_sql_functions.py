"""MySQL semantics in SQL text, and names compared by collation."""

from datetime import datetime as dt
from decimal import Decimal

import pytest

import __spark_entry__ as E
from churnlens.functions.sql import register_functions
from churnlens.operators.model import translated_categories, value_by_category

SF = "/root/testdata/sf0.001"


def months(a, b):
    """MySQL's TIMESTAMPDIFF(MONTH, a, b)."""
    if b < a:
        return -months(b, a)
    return (b.year - a.year) * 12 + b.month - a.month - ((b.day, b.time()) < (a.day, a.time()))


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Kathmandu"])
def test_date_functions_do_not_depend_on_the_time_zone(spark, zone):
    times = [dt(2018, 1, 31, 23, 59, 59, 999999), dt(2018, 2, 28), dt(2018, 2, 28, 0, 0, 0, 1), dt(2018, 10, 20, 23, 30), dt(2018, 11, 4, 0, 30), dt(2017, 10, 15, 3), dt(2016, 2, 29)]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        register_functions(spark)
        spark.createDataFrame([(a, b) for a in times for b in times], "a timestamp_ntz, b timestamp_ntz").createOrReplaceTempView("pairs")
        for r in spark.sql("""SELECT a, b, timestampdiff_month(a, b) AS m, timestampdiff_day(a, b) AS d, timestampdiff_minute(a, b) AS i,
                                     calendar_days(b, a) AS c, month_start(a) AS s, months_apart(month_start(a), month_start(b)) AS p FROM pairs""").collect():
            apart = (r.b - r.a).total_seconds()
            assert r.m == months(r.a, r.b) and r.d == int(apart / 86400) and r.i == int(apart / 60), (r.a, r.b)
            assert r.c == (r.b.date() - r.a.date()).days and r.s == r.a.date().replace(day=1)
            assert r.p == (r.b.year - r.a.year) * 12 + r.b.month - r.a.month
        assert spark.sql("SELECT timestampdiff_month(NULL, NULL)").first()[0] is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_rounding_functions(spark):
    register_functions(spark)
    r = spark.sql("SELECT pct_of(1, 3), pct_of(1, 8), pct_of(5, 0), avg_round(5, 2, 0), avg_round(-5, 2, 0), avg_round(1, 8, 2), avg_round(7, 0, 1)").first()
    assert tuple(r) == (33.33, 12.5, None, 3.0, -3.0, 0.13, None)


@pytest.mark.parametrize("key", ["funnel_by_month", "score_by_lateness"])
def test_queries_as_text_equal_their_frames(spark, key):
    q = E.queries()
    a, b = q[key](spark, SF), q[f"{key}_sql"](spark, SF)
    assert a.columns == b.columns and a.collect() == b.collect()


def test_names_are_compared_by_collation(spark):
    products = spark.createDataFrame([(1, "CAFÉ"), (2, "cafe"), (3, "Café"), (4, "tea"), (5, None), (6, "TÉA"), (7, "other")], "product_id long, product_category_name string")
    translation = spark.createDataFrame([("café", "coffee")], "product_category_name string, product_category_name_english string")
    items = spark.createDataFrame([(i, Decimal("1.50"), Decimal("0.50")) for i in (1, 1, 2, 3, 4, 5, 6, 7)], "product_id long, price decimal(10,2), freight_value decimal(10,2)")
    rows = lambda c: [tuple(r) for r in value_by_category(items, translated_categories(products, translation, collation=c)).collect()]
    assert rows("UNICODE_CI_AI") == [("TÉA", 2, 2, 4.0), ("coffee", 3, 4, 8.0), ("other", 1, 1, 2.0), ("unknown", 1, 1, 2.0)]
    assert len(rows(None)) == 7
