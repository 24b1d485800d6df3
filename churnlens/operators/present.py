"""Chart-ready result tables (the reference draws these; we deliver the tables).

Only aggregated results are reshaped here; nothing larger than the cohort grid
(cohorts x 13 cells) is ever pivoted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.numeric import int_round_col

# A cell's share of its cohort in percent, not rounded.
_SHARE = "1e2 * CAST(active_customers AS DOUBLE) / CAST(cohort_size AS DOUBLE)"


def heatmap_matrix(grid: DataFrame, max_index: int = 12) -> DataFrame:
    """Cohort x month-index matrix of % retained (not rounded); unobservable cells are NULL.

    Rows carry the label 'Mon YYYY (n=1,234)'. Columns m0..m<max_index>.
    """
    masked = grid.withColumn("_v", F.when(F.col("is_observable") == 1, F.expr(_SHARE)))
    wide = (masked.groupBy("cohort_month", "cohort_size")
            .pivot("month_index", list(range(max_index + 1))).agg(F.max("_v")))  # one cell each
    label = F.concat(F.date_format("cohort_month", "MMM yyyy"), F.lit(" (n="),
                     F.format_number("cohort_size", 0), F.lit(")"))
    return wide.select("cohort_month", label.alias("cohort_label"), "cohort_size",
                       *[F.col(str(i)).alias(f"m{i}") for i in range(max_index + 1)]).orderBy("cohort_month")


def heatmap_scale(grid: DataFrame, floor_pct: float = 0.5) -> DataFrame:
    """Colour-scale cap (largest observable month>=1 cell, at least ``floor_pct``)
    and the mean month-1 retention over cohorts that have a month-1 cell.

    Both are taken from shares that are not rounded; the mean is summed in units of
    1e-9 (so the order of rows does not matter) and rounded to 6 digits.
    """
    obs = grid.filter(F.col("is_observable") == 1).withColumn("_p", F.expr(_SHARE))
    return obs.agg(
        F.greatest(F.max(F.when(F.col("month_index") >= 1, F.col("_p"))), F.lit(floor_pct)).alias("scale_max"),
        F.sum(F.when(F.col("month_index") == 1, F.round(F.col("_p") * 1e9).cast("bigint"))).alias("_s1"),
        F.count(F.when(F.col("month_index") == 1, F.lit(1))).alias("cohorts_with_month1"),
    ).select("scale_max", (int_round_col("_s1", "cohorts_with_month1 * 1000") / F.lit(1e6)).alias("mean_month1_pct"),
             "cohorts_with_month1")


def segment_shares(rfm: DataFrame, segment: str = "segment") -> DataFrame:
    """Per segment: customers, revenue and both shares (unrounded), by revenue share."""
    g = rfm.groupBy(segment).agg(F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("_rev"))
    w = Window.partitionBy()
    g = g.withColumn("_tc", F.sum("customers").over(w)).withColumn("_tr", F.sum("_rev").over(w))
    return g.select(
        segment, "customers", F.col("_rev").cast("double").alias("revenue"),
        F.expr("1e2 * CAST(customers AS DOUBLE) / CAST(_tc AS DOUBLE)").alias("pct_customers"),
        F.expr("1e2 * CAST(_rev AS DOUBLE) / CAST(_tr AS DOUBLE)").alias("pct_revenue"),
    ).orderBy(F.col("pct_revenue").desc(), F.col(segment))
