"""Calendar arithmetic with the reference's MySQL semantics, for both engines.

* month start         DATE_FORMAT(ts, '%Y-%m-01') cast to DATE
* month index         TIMESTAMPDIFF(MONTH) between two month starts
* whole days/minutes  TIMESTAMPDIFF(DAY|MINUTE): elapsed whole units, toward zero
* calendar days       DATEDIFF: difference of the two dates
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(ts: str, dialect: str = "spark") -> str:
    if dialect == "spark":
        return f"trunc({ts}, 'MM')"
    return f"CAST(date_trunc('month', {ts}) AS DATE)"


def month_index(start: str, end: str, dialect: str = "spark") -> str:
    """Whole months between two month-start dates (same text in both engines)."""
    return (f"CAST((year({end}) * 12 + month({end})) - "
            f"(year({start}) * 12 + month({start})) AS BIGINT)")


def whole_days(start: str, end: str, dialect: str = "spark") -> str:
    """Whole elapsed days, toward zero, on wall-clock (zone-free) timestamps.

    Spark's ``timestampdiff`` converts TIMESTAMP_NTZ through the session time
    zone, so across a daylight-saving change it can gain or lose an hour.
    Subtracting two TIMESTAMP_NTZ values gives a zone-free day-time interval
    whose fields are truncated toward zero, like MySQL's TIMESTAMPDIFF.
    """
    if dialect == "spark":
        return f"CAST(extract(DAY FROM ({end}) - ({start})) AS BIGINT)"
    return f"date_sub('day', {start}, {end})"


def whole_minutes(start: str, end: str, dialect: str = "spark") -> str:
    """Whole elapsed minutes, toward zero, on wall-clock (zone-free) timestamps."""
    if dialect == "spark":
        iv = f"(({end}) - ({start}))"
        return (f"(CAST(extract(DAY FROM {iv}) AS BIGINT) * 1440 + CAST(extract(HOUR FROM {iv}) AS BIGINT) * 60"
                f" + CAST(extract(MINUTE FROM {iv}) AS BIGINT))")
    return f"date_sub('minute', {start}, {end})"


def calendar_days(end: str, start: str, dialect: str = "spark") -> str:
    """DATEDIFF(end, start) on the calendar dates of two timestamps."""
    if dialect == "spark":
        return f"datediff(CAST({end} AS DATE), CAST({start} AS DATE))"
    return f"date_diff('day', CAST({start} AS DATE), CAST({end} AS DATE))"


def add_months(d: str, n: str, dialect: str = "spark") -> str:
    if dialect == "spark":
        return f"add_months({d}, {n})"
    return f"CAST({d} + to_months(CAST({n} AS INTEGER)) AS DATE)"


def month_start_col(ts: str) -> Column:
    return F.expr(month_start(ts))


def month_index_col(start: str, end: str) -> Column:
    return F.expr(month_index(start, end))


def whole_days_col(start: str, end: str) -> Column:
    return F.expr(whole_days(start, end))


def whole_minutes_col(start: str, end: str) -> Column:
    return F.expr(whole_minutes(start, end))


def calendar_days_col(end: str, start: str) -> Column:
    return F.expr(calendar_days(end, start))
