"""MySQL's date and rounding functions for ``spark.sql``, as SQL-defined functions.

``register_functions`` creates them as temporary functions of the session, so a query over ``Tables.register_views`` can be
written as text with the reference's semantics: whole elapsed units on wall-clock times (Spark's own ``timestampdiff`` goes through
the session time zone), and rounding half away from zero on exact quotients. They are plain SQL expressions: the optimizer inlines them, and
they run in generated code like the DataFrame forms, whose text they share.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from churnlens.functions import dates, numeric

_TS, _DEC = "TIMESTAMP_NTZ", "DECIMAL(38,4)"

#: name -> (parameters, result type, expression)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "month_start": (f"ts {_TS}", "DATE", dates.month_start("ts")),
    "months_apart": ("first DATE, later DATE", "BIGINT", dates.month_index("first", "later")),
    # a month is whole when the same day and time of the later month is reached
    "timestampdiff_month": (f"a {_TS}, b {_TS}", "BIGINT", "CASE WHEN b >= a THEN {up} ELSE -({down}) END".format(
        up="(year(b) - year(a)) * 12 + month(b) - month(a) - CASE WHEN {b} < {a} THEN 1 ELSE 0 END".format(
            a="date_format(a, 'dd HH:mm:ss.SSSSSS')", b="date_format(b, 'dd HH:mm:ss.SSSSSS')"),
        down="(year(a) - year(b)) * 12 + month(a) - month(b) - CASE WHEN {a} < {b} THEN 1 ELSE 0 END".format(
            a="date_format(a, 'dd HH:mm:ss.SSSSSS')", b="date_format(b, 'dd HH:mm:ss.SSSSSS')"))),
    "timestampdiff_day": (f"a {_TS}, b {_TS}", "BIGINT", dates.whole_days("a", "b")),
    "timestampdiff_minute": (f"a {_TS}, b {_TS}", "BIGINT", dates.whole_minutes("a", "b")),
    "calendar_days": (f"later {_TS}, first {_TS}", "INT", dates.calendar_days("later", "first")),
    "avg_round": ("total DECIMAL(38,0), n BIGINT, digits INT", "DOUBLE",
                  "CASE digits " + " ".join(f"WHEN {d} THEN {numeric.avg_exact('total', 'n', d)}" for d in range(5)) + " END"),
    "pct_of": ("part BIGINT, whole BIGINT", "DOUBLE", numeric.pct("part", "whole")),
}


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Creates (or replaces) the temporary functions, each ``prefix`` + name; returns the names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN CAST({body} AS {result})")
    return [prefix + name for name in FUNCTIONS]
