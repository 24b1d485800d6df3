"""Elapsed-time helpers follow wall-clock semantics whatever the session time zone."""

import duckdb
import pytest

from churnlens.functions.dates import calendar_days, month_index, month_start, whole_days, whole_minutes

PAIRS = [("2017-03-11 02:30:00", "2017-03-12 02:30:00"),   # across a spring-forward change
         ("2017-03-12 01:30:00", "2017-03-12 03:30:00"),
         ("2017-11-04 23:30:00", "2017-11-05 01:30:00"),   # across a fall-back change
         ("2017-01-01 00:00:00.9", "2017-01-01 00:01:00.5"),
         ("2017-01-02 00:00:00", "2017-01-01 00:00:30"),   # negative: toward zero
         ("2017-01-31 23:00:00", "2017-02-01 01:00:00")]


@pytest.mark.parametrize("tz", ["UTC", "America/New_York", "Australia/Sydney"])
def test_diffs_match_duckdb_in_any_session_zone(spark, tz):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", tz)
    try:
        df = spark.createDataFrame(PAIRS, "a string, b string").selectExpr(
            "CAST(a AS TIMESTAMP_NTZ) AS a", "CAST(b AS TIMESTAMP_NTZ) AS b")
        exprs = [whole_minutes("a", "b"), whole_days("a", "b"), calendar_days("b", "a"),
                 month_index(month_start("a"), month_start("b"))]
        got = [tuple(r) for r in df.selectExpr(*exprs).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    con = duckdb.connect()
    for (a, b), g in zip(PAIRS, got):
        row = con.execute(
            "SELECT " + ", ".join([whole_minutes("x.a", "x.b", "duckdb"), whole_days("x.a", "x.b", "duckdb"),
                                   calendar_days("x.b", "x.a", "duckdb"),
                                   month_index(month_start("x.a", "duckdb"), month_start("x.b", "duckdb"), "duckdb")])
            + f" FROM (SELECT TIMESTAMP '{a}' AS a, TIMESTAMP '{b}' AS b) x").fetchone()
        assert g == tuple(row), (tz, a, b)
