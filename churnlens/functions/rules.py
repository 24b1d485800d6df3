"""Ordered rule lists: ``[(condition, label), ...]`` with a default label.

The first matching condition wins, exactly like a searched CASE. Conditions are
SQL boolean text over the frame's columns, so one rule list drives the Spark
operator (``F.expr``) and the oracle SQL alike. Rule lists are data: callers
can pass their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]


def _quote(label: str) -> str:
    return "'" + label.replace("'", "''") + "'"


def case_sql(rules: Rules, default: str | None) -> str:
    whens = " ".join(f"WHEN {cond} THEN {_quote(label)}" for cond, label in rules)
    tail = f" ELSE {_quote(default)}" if default is not None else ""
    return f"CASE {whens}{tail} END"


def case_col(rules: Rules, default: str | None) -> Column:
    return F.expr(case_sql(rules, default))


# ---------------------------------------------------------------------------
# Rule lists, labels and bucket edges as the reference states them.
# ---------------------------------------------------------------------------

# RFM segments on the threshold frequency score (first match wins).
SEGMENT_RULES: Rules = [
    ("r_score >= 4 AND f_score >= 4", "Champions"),
    ("r_score <= 2 AND f_score >= 5", "Cannot Lose Them"),
    ("r_score >= 3 AND f_score >= 3", "Loyal Customers"),
    ("r_score <= 2 AND f_score >= 3", "At Risk"),
    ("r_score = 5 AND f_score <= 2", "New Customers"),
    ("r_score = 4 AND f_score <= 2", "Promising"),
    ("r_score = 3 AND f_score <= 2", "Needs Attention"),
    ("r_score <= 2 AND f_score <= 2", "Hibernating"),
]
SEGMENT_DEFAULT = "Others"

# The same table on the NTILE frequency score; the second rule reads
# "r_score >= 2" in the reference's variant and is kept literally.
SEGMENT_RULES_NTILE: Rules = [
    ("r_score >= 4 AND f_score_ntile >= 4", "Champions"),
    ("r_score >= 2 AND f_score_ntile >= 5", "Cannot Lose Them"),
    ("r_score >= 3 AND f_score_ntile >= 3", "Loyal Customers"),
    ("r_score <= 2 AND f_score_ntile >= 3", "At Risk"),
    ("r_score = 5 AND f_score_ntile <= 2", "New Customers"),
    ("r_score = 4 AND f_score_ntile <= 2", "Promising"),
    ("r_score = 3 AND f_score_ntile <= 2", "Needs Attention"),
    ("r_score <= 2 AND f_score_ntile <= 2", "Hibernating"),
]

# Coarse labellings compared side by side (kept literally, including case).
AGREEMENT_RULES_RULE: Rules = [
    ("r_score >= 4 AND f_score >= 4", "Champions"),
    ("r_score >= 2 AND f_score >= 3", "at risk"),
    ("r_score <= 2 AND f_score <= 2", "Hibernating"),
]
AGREEMENT_DEFAULT_RULE = "Other"
AGREEMENT_RULES_NTILE: Rules = [
    ("r_score >= 4 AND f_score_ntile >= 4", "Champions"),
    ("r_score <= 2 AND f_score_ntile >= 3", "at risk"),
    ("r_score <= 2 AND f_score_ntile <= 2", "Hibernating"),
]
AGREEMENT_DEFAULT_NTILE = "other"

# Threshold frequency score: 3+ orders -> 5, 2 orders -> 3, else 1.
F_SCORE_RULES: Rules = [("frequency >= 3", "5"), ("frequency = 2", "3")]
F_SCORE_DEFAULT = "1"

# Outcome of a person's first order.
DELIVERY_CLASS_RULES: Rules = [
    ("delivered_at IS NULL", "never delivered"),
    ("delivered_at > estimated_at", "late"),
]
DELIVERY_CLASS_DEFAULT = "on time"

# Tenure buckets in days since the first order.
TENURE_RULES: Rules = [
    ("tenure_days <= 90", "1. 0-3 months"),
    ("tenure_days <= 180", "2. 3-6 months"),
    ("tenure_days <= 365", "3. 6-12 months"),
]
TENURE_DEFAULT = "4. 12+ months"

# Delivery date against the promised date, in calendar days.
LATENESS_RULES: Rules = [
    ("days_late < -7", "1. more than a week early"),
    ("days_late < 0", "2. early"),
    ("days_late = 0", "3. on the promised day"),
    ("days_late <= 3", "4. 1-3 days late"),
    ("days_late <= 7", "5. 4-7 days late"),
    ("days_late <= 14", "6. 1-2 weeks late"),
]
LATENESS_DEFAULT = "7. more than 2 weeks late"

# Single-order persons split by tenure.
VERDICT_RULES: Rules = [
    ("tenure_days <= 90", "Recently acquired, not yet repeated(winnable)"),
]
VERDICT_DEFAULT = "Long tenure, never repeated (likely lost)"

# Order statuses excluded from the valid-order population.
EXCLUDED_STATUSES = ("canceled", "unavailable")
