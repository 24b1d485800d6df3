"""Cohorts and repeat purchase.

Person-level work is always reduced first to (person, month) pairs - a partial
aggregate, so no person's order history reaches one task - and only then
windowed per person: a person's window then holds at most one row per month of
data, whatever the number of orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.dates import month_index_col, month_start_col, whole_days_col
from churnlens.functions.numeric import avg_exact_col, pct_col
from churnlens.operators.funnel import STEP_BITS, value_quantiles
from churnlens.operators.model import first_by
from churnlens.operators.ranking import previous_in_group


def person_months(activity: DataFrame, entity: str, ts: str, value: str | None = None) -> DataFrame:
    """(entity, activity_month[, value]) with one row per active month.

    ``value`` (optional) is summed per month; NULL timestamps are dropped.
    """
    base = activity.filter(F.col(ts).isNotNull()).select(
        F.col(entity).alias("entity"), month_start_col(ts).alias("activity_month"),
        *([F.col(value).alias("value")] if value else []))
    if value:
        return base.groupBy("entity", "activity_month").agg(F.sum("value").alias("value"))
    return base.distinct()


def with_cohort(pm: DataFrame) -> DataFrame:
    """Add cohort_month (the entity's first active month) and month_index."""
    first = F.min("activity_month").over(Window.partitionBy("entity"))
    return (pm.withColumn("cohort_month", first)
            .withColumn("month_index", month_index_col("cohort_month", "activity_month")))


def _clip(df: DataFrame, clip: tuple[str, str] | None, col: str = "cohort_month") -> DataFrame:
    if clip is None:
        return df
    return df.filter(F.col(col).between(F.to_date(F.lit(clip[0])), F.to_date(F.lit(clip[1]))))


def cohort_retention(activity: DataFrame, entity: str = "person", ts: str = "ts",
                     max_index: int = 12, clip: tuple[str, str] | None = None,
                     dense: bool = False) -> DataFrame:
    """Monthly cohort grid: cohort size, distinct active entities, % retained.

    ``is_observable`` is 1 when the cell's month is not after the last month with
    data. The sparse grid (default) holds only cells with activity, as the
    reference's query does; ``dense=True`` adds explicit zero cells for every
    index 0..max_index, where ``is_observable`` separates real zeros from the
    future.
    """
    cells = with_cohort(person_months(activity, entity, ts))
    grid = _grid_windows(
        cells.groupBy("cohort_month", "month_index").agg(F.count(F.lit(1)).alias("active_customers")),
        "active_customers", "cohort_size")
    grid = _clip(grid, clip)
    if dense:
        idx = (grid.filter(F.col("month_index") == 0)
               .select("cohort_month", "cohort_size", "last_month",
                       F.explode(F.sequence(F.lit(0), F.lit(max_index))).alias("month_index"))
               .withColumn("month_index", F.col("month_index").cast("bigint")))
        out = (idx.join(grid.select("cohort_month", "month_index", "active_customers"),
                        ["cohort_month", "month_index"], "left")
               .withColumn("active_customers", F.coalesce("active_customers", F.lit(0)).cast("bigint")))
    else:
        out = grid.filter(F.col("month_index").between(0, max_index))
    observable = F.add_months("cohort_month", F.col("month_index").cast("int")) <= F.col("last_month")
    return out.select(
        "cohort_month",
        F.col("cohort_size").cast("bigint").alias("cohort_size"),
        F.col("month_index").cast("bigint").alias("month_index"),
        F.col("active_customers").cast("bigint").alias("active_customers"),
        pct_col("active_customers", "cohort_size").alias("pct_retained"),
        F.when(observable, 1).otherwise(0).cast("bigint").alias("is_observable"),
    ).orderBy("cohort_month", "month_index")


def _grid_windows(grid: DataFrame, value: str, base: str) -> DataFrame:
    """Add the cohort's month-0 value and the last month with data to each cell.

    Windows over the aggregated grid only: at most (months of data)^2 rows, so
    the whole-grid window is bounded by the time span, not by the data size.
    """
    month0 = F.sum(F.when(F.col("month_index") == 0, F.col(value))).over(Window.partitionBy("cohort_month"))
    last = F.max(F.add_months("cohort_month", F.col("month_index").cast("int"))).over(Window.partitionBy())
    return grid.withColumn(base, month0).withColumn("last_month", last)


def revenue_retention(activity: DataFrame, entity: str = "person", ts: str = "ts",
                      value: str = "rev", max_index: int = 12,
                      clip: tuple[str, str] | None = None) -> DataFrame:
    """Cohort grid in revenue: month-0 revenue, cell revenue, % of month 0.

    Revenue is pre-summed per (entity, month); cohort month-0 revenue comes from
    the same cell aggregate (one pass).
    """
    cells = with_cohort(person_months(activity, entity, ts, value))
    grid = _grid_windows(cells.groupBy("cohort_month", "month_index").agg(F.sum("value").alias("cell_revenue")),
                         "cell_revenue", "month0_revenue")
    out = _clip(grid.filter(F.col("month_index").between(0, max_index)), clip)
    cents = lambda c: (F.col(c) * 100).cast("decimal(38,0)")
    return out.select(
        "cohort_month",
        F.col("month0_revenue").cast("double").alias("month0_revenue_brl"),
        F.col("month_index").cast("bigint").alias("month_index"),
        F.col("cell_revenue").cast("double").alias("cell_revenue_brl"),
        cents("cell_revenue").alias("_c"), cents("month0_revenue").alias("_b"),
    ).withColumn("pct_revenue_retained", pct_col("_c", "_b")).drop("_c", "_b") \
     .orderBy("cohort_month", "month_index")


def repeat_rate(orders: DataFrame, entity: str = "person", order_id: str = "order_id",
                distinct: bool = True) -> DataFrame:
    """Entities, entities with more than one order, and the repeat %.

    ``distinct=True`` counts distinct order ids per entity, else rows.
    """
    n = F.countDistinct(order_id) if distinct else F.count(F.lit(1))
    per = orders.groupBy(entity).agg(n.alias("n_orders"))
    return per.agg(F.count(F.lit(1)).alias("customers"),
                   F.count_if(F.col("n_orders") > 1).alias("repeaters")) \
        .withColumn("repeat_rate_pct", pct_col("repeaters", "customers"))


def frequency_histogram(orders: DataFrame, entity: str = "person") -> DataFrame:
    """How many entities placed 1, 2, 3... orders (rows per entity)."""
    per = orders.groupBy(entity).agg(F.count(F.lit(1)).alias("orders_per_person"))
    return (per.groupBy("orders_per_person").agg(F.count(F.lit(1)).alias("people"))
            .orderBy("orders_per_person"))


def gap_stats(orders: DataFrame, entity: str = "person", ts: str = "ts",
              tie: str = "order_id", median: str = "mid") -> DataFrame:
    """Whole days between consecutive orders of an entity: count, median, mean.

    ``median="mid"`` averages the two middle rows of an even count; ``"lower"``
    takes the lower one (the reference's formula). The previous
    order is found through a global rank, so a very active entity is split
    across tasks. Rows with a NULL timestamp start no gap and end none.
    """
    g = orders.filter(F.col(ts).isNotNull()).select(entity, ts, tie)
    prev = previous_in_group(g, entity, [ts, tie], ts, "_prev_ts")
    d = prev.filter(F.col("_prev_ts").isNotNull()).select(whole_days_col("_prev_ts", ts).alias("d"))
    stats = value_quantiles(d, [], "d", bits=STEP_BITS)
    return stats.select(
        F.col("n").alias("repeat_purchase_events"),
        F.col("low_median" if median == "lower" else "median").alias("median_days_between"),
        avg_exact_col("total", "n", 1).alias("mean_days_between"))


def repeat_by_first(orders: DataFrame, totals: DataFrame | None, class_col: str, entity: str = "person",
                    ts: str = "ts", tie: str = "order_id", payload: tuple[str, ...] = ()) -> DataFrame:
    """Class of each entity's first order -> entities and repeat % per class.

    ``orders`` holds the candidate first orders, ``totals`` (entity, n_orders)
    the entity's order count, or None to count distinct ``tie`` values of
    ``orders`` in the same aggregate as the first order (one shuffle, no join);
    ``class_col`` is an expression over the first order's columns in ``payload``.
    """
    if totals is None:
        fields = [ts, tie] + [p for p in payload if p not in (ts, tie)]
        per = (orders.groupBy(entity)
               .agg(F.min(F.struct(*[F.col(c) for c in fields])).alias("_first"),
                    F.countDistinct(tie).alias("n_orders"))
               .select(entity, "n_orders", *[F.col(f"_first.{c}").alias(c) for c in fields])
               .select(entity, F.expr(class_col).alias("class"), "n_orders"))
    else:
        first = first_by(orders, entity, [ts, tie], list(payload))
        per = first.select(entity, F.expr(class_col).alias("class")).join(totals, entity)
    return per.groupBy("class").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("n_orders") > 1).alias("_rep"),
    ).withColumn("repeat_rate_pct", pct_col("_rep", "customers")).drop("_rep")


def fair_window_repeat(activity: DataFrame, dims: DataFrame | None, entity: str = "person",
                       ts: str = "ts", window: tuple[int, int] = (1, 3),
                       eligible_from: str | None = None, eligible_to: str | None = None,
                       min_n: int = 0, dim: str = "dim", dim_expr: str | None = None) -> DataFrame:
    """Return rate within months ``window`` of acquisition, compared across a dimension.

    ``dims`` gives one ``dim`` value per entity (state of the first order, its
    first category, ...); entities missing from ``dims`` are left out. With
    ``dims=None`` the dimension is ``dim_expr`` over the cohort month
    (e.g. ``year(cohort_month)``). Only
    cohorts between ``eligible_from`` and ``eligible_to`` count; when
    ``eligible_to`` is None it is the last cohort whose whole window is observed
    (last month with data minus ``window[1]`` months). Groups smaller than
    ``min_n`` are dropped.
    """
    lo, hi = window
    cells = with_cohort(person_months(activity, entity, ts))
    per = cells.groupBy("entity", "cohort_month").agg(
        F.bool_or(F.col("month_index").between(lo, hi)).alias("returned"), F.max("activity_month").alias("_last"))
    if dims is None:
        joined = per.withColumn("_dim", F.expr(dim_expr)).withColumn("_in", F.lit(True))
    else:
        own = dims.select(F.col(entity).alias("entity"), F.col(dim).alias("_dim"), F.lit(True).alias("_in"))
        joined = per.join(own, "entity", "left")
    # the last month with data is taken from this small grid (dimension x cohort), not from a second
    # pass over the orders; entities outside ``dims`` count for it and for nothing else
    grid = joined.groupBy("_dim", "_in", "cohort_month").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("returned").alias("_r"), F.max("_last").alias("_last"))
    if eligible_to is None:
        grid = grid.withColumn("_to", F.add_months(F.max("_last").over(Window.partitionBy()), -hi))
        grid = grid.filter(F.col("cohort_month") <= F.col("_to"))
    else:
        grid = grid.filter(F.col("cohort_month") <= F.to_date(F.lit(eligible_to)))
    if eligible_from is not None:
        grid = grid.filter(F.col("cohort_month") >= F.to_date(F.lit(eligible_from)))
    out = grid.filter("_in").groupBy("_dim").agg(F.sum("_n").alias("customers"), F.sum("_r").alias("repeaters"))
    return (out.filter(F.col("customers") >= min_n)
            .withColumn("repeat_rate_pct", pct_col("repeaters", "customers"))
            .withColumnRenamed("_dim", dim)
            .orderBy(F.col("repeat_rate_pct").desc(), F.col(dim)))


def avg_order_value(orders: DataFrame, values: DataFrame) -> DataFrame:
    """Mean revenue per order over orders that have items, and their number.

    As SQL's AVG, the mean leaves out orders whose revenue is NULL; they are counted.
    """
    per = orders.select("order_id").join(values, "order_id")
    return per.agg(F.sum("order_revenue").alias("_s"), F.count("order_revenue").alias("_n"), F.count(F.lit(1)).alias("orders")) \
        .select(avg_exact_col("_s", "_n", 2).alias("avg_order_value_brl"), "orders")
