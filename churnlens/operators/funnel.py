"""Funnel and fulfilment operators.

Stages come from timestamps, not from the status snapshot, and are forced to
nest: stage k counts a row only when the timestamps of stages 1..k are all
present. Every operator reads its input once: conditional aggregates in one
pass, and an ``explode`` unpivot instead of one scan per stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.dates import month_start_col, whole_minutes_col
from churnlens.functions.numeric import avg_exact_col, pct_col, round_col
from churnlens.functions.rules import Rules, case_col

# Approximate variants for value domains too wide for exact value counts
# (fixed-size sketch per group; relative rank error about 1 / accuracy).
MEDIAN_APPROX = "CAST(percentile_approx({v}, 0.5, {acc}) AS DOUBLE)"
P90_APPROX = "CAST(percentile_approx({v}, 0.9, {acc}) AS DOUBLE)"


#: Bits of a value that one step of the exact quantiles tells apart: a step orders at most 2 ** STEP_BITS counts of a group.
STEP_BITS = 12


def value_quantiles(df: DataFrame, dims: Sequence[str], value: str, flag: str | None = None, bits: int = 2 * STEP_BITS) -> DataFrame:
    """Per ``dims``: n, median (mean of the two middle rows), low_median, p90 (row ceil(0.9 n)), total[, flagged]. Exact.

    ``value`` is a whole number. Rows are first counted per (dims, value): a partial aggregate dealt out by both, so the rows
    of one group meet in many tasks. If values take at most ``bits`` = ``STEP_BITS`` bits (whole days), a group's few counts are ordered and a
    quantile is the first value whose running count reaches its row. Wider values (minutes, cents) are counted by their high digits, step by
    step; a group's few highest cells tell in which cell each quantile's row lies, and only the counts within that cell are looked
    at, so no task orders all values of a group. Results don't depend on ``bits``, only how many counts a step orders. NULL values are left out.
    """
    marks = [F.count_if(F.col(flag)).alias("_flagged")] if flag else []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*dims, F.col(value).cast("long").alias("_value")).agg(
        F.count(F.lit(1)).alias("_times"), *marks)
    if bits > STEP_BITS:
        return _descended(counts, dims, bool(flag), bits)
    group = Window.partitionBy(*dims)
    upto = F.sum("_times").over(group.orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_times").over(group))
    at = lambda row: F.min(F.when(F.col("_upto") >= F.expr(row), F.col("_value")))
    low, high, p90 = (at(row) for row in _QUANTILE_ROWS)
    return _quantiles(c.groupBy(*dims).agg(
        F.coalesce(F.sum("_times"), F.lit(0)).alias("n"), low.alias("_0"), high.alias("_1"), p90.alias("_2"),
        F.sum(F.col("_value") * F.col("_times")).alias("total"), *([F.sum("_flagged").alias("flagged")] if flag else [])), dims)


#: Rows (1-based) of the two middle values and of the ninth decile among _n.
_QUANTILE_ROWS = ("(_n + 1) div 2", "(_n + 2) div 2", "(9 * _n + 9) div 10")


def _quantiles(found: DataFrame, dims: Sequence[str]) -> DataFrame:
    return found.select(*dims, "n", ((F.col("_0") + F.col("_1")) / F.lit(2.0)).alias("median"), F.col("_0").cast("double").alias("low_median"),
                        F.col("_2").cast("double").alias("p90"), "total", *[c for c in ("flagged",) if c in found.columns])


def _reached(counts: Column, row: Column) -> Column:
    """From an array of (at, times), ascending: the ``at`` whose running count reaches ``row``, and the row's place among its own."""
    start = F.struct(row.cast("long").alias("row"), F.lit(None).cast("long").alias("at"))
    step = lambda a, c: F.when(a["at"].isNotNull(), a).when(a["row"] <= c["times"], F.struct(a["row"].alias("row"), c["at"].alias("at"))) \
        .otherwise(F.struct((a["row"] - c["times"]).alias("row"), a["at"].alias("at")))
    return F.aggregate(counts, start, step)


def _descended(counts: DataFrame, dims: Sequence[str], flagged: bool, bits: int) -> DataFrame:
    """Quantiles from counts per (dims, value): down from the highest digits, one join a step with the cells sought."""
    sums = [F.sum("_times").alias("_times"), F.sum("_total").alias("_total"), *([F.sum("_flagged").alias("_flagged")] if flagged else [])]
    levels = [counts.withColumn("_total", F.col("_value") * F.col("_times")).withColumnRenamed("_value", "_at")]
    for _ in range(-(-bits // STEP_BITS) - 1):             # by value, by value / 2^12, ...
        levels.append(levels[-1].groupBy(*dims, F.shiftright("_at", STEP_BITS).alias("_at")).agg(*sums))
    listed = F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_times").alias("times"))))
    # one row a group: its quantiles' cells of the highest digit
    top = levels[-1].groupBy(*dims).agg(listed.alias("_cells"), *sums).select(*dims, "_cells", F.col("_times").alias("_n"), "_total", *(["_flagged"] if flagged else []))
    kept = ["_n", "_total", *(["_flagged"] if flagged else [])]
    sought = top.select(*dims, *kept, *[_reached(F.col("_cells"), F.expr(row)).alias(f"_{i}") for i, row in enumerate(_QUANTILE_ROWS)])
    for level in reversed(levels[:-1]):
        each = sought.select(*dims, *kept, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_{i}.row").alias("row"), F.col(f"_{i}.at").alias("at"))
                                                               for i in range(len(_QUANTILE_ROWS))])).alias("_s"))
        each = each.select(*[F.col(d).alias(f"_g{k}") for k, d in enumerate(dims)], *[F.col(c).alias(f"_{c}") for c in kept], F.col("_s.i").alias("_i"),
                           F.col("_s.row").alias("_row"), F.col("_s.at").alias("_cell"))
        same = F.shiftright("_at", STEP_BITS) == F.col("_cell")
        for k, d in enumerate(dims):
            same = same & F.col(d).eqNullSafe(F.col(f"_g{k}"))
        each = each if dims else F.broadcast(each)           # one row a quantile without groups; else Spark goes by the size
        of = lambda i, c: F.when(F.col("_i") == i, c)
        within = level.join(each, same).groupBy(*dims).agg(
            *[F.max(f"_{c}").alias(c) for c in kept], *[F.max(of(i, F.col("_row"))).alias(f"_r{i}") for i in range(len(_QUANTILE_ROWS))],
            *[F.array_sort(F.collect_list(of(i, F.struct(F.col("_at").alias("at"), F.col("_times").alias("times"))))).alias(f"_c{i}") for i in range(len(_QUANTILE_ROWS))])
        sought = within.select(*dims, *kept, *[_reached(F.col(f"_c{i}"), F.col(f"_r{i}")).alias(f"_{i}") for i in range(len(_QUANTILE_ROWS))])
    return _quantiles(sought.select(*dims, F.coalesce("_n", F.lit(0)).alias("n"), F.col("_total").alias("total"), *([F.col("_flagged").alias("flagged")] if flagged else []),
                                    *[F.col(f"_{i}.at").alias(f"_{i}") for i in range(len(_QUANTILE_ROWS))]), dims)


def _sketched_quantiles(df: DataFrame, dims: Sequence[str], value: str, flag: str | None, accuracy: int) -> DataFrame:
    med, p90 = (F.expr(x.format(v=value, acc=accuracy)) for x in (MEDIAN_APPROX, P90_APPROX))
    return df.filter(F.col(value).isNotNull()).groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n"), med.alias("median"), med.alias("low_median"), p90.alias("p90"),
        F.sum(value).alias("total"), *([F.count_if(F.col(flag)).alias("flagged")] if flag else []))


def _nested_conditions(stages: Sequence[tuple[str, str | None]]):
    conds, acc = [], F.lit(True)
    for _, col in stages:
        if col is not None:
            acc = acc & F.col(col).isNotNull()
        conds.append(acc)
    return conds


def funnel_counts(df: DataFrame, stages: Sequence[tuple[str, str | None]]) -> DataFrame:
    """(step_no, stage, orders): rows reaching each nested stage, in one pass.

    ``stages`` is ``[(label, timestamp column or None), ...]`` in funnel order; a
    stage with ``None`` is reached by every row.
    """
    conds = _nested_conditions(stages)
    counts = df.agg(*[F.count_if(c).alias(f"_s{i}") for i, c in enumerate(conds)])
    rows = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("step_no"), F.lit(label).alias("stage"),
                              F.col(f"_s{i}").cast("bigint").alias("orders"))
                     for i, (label, _) in enumerate(stages)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def funnel(df: DataFrame, stages: Sequence[tuple[str, str | None]]) -> DataFrame:
    """Nested funnel: count, % of the first stage, step conversion %, drop per step."""
    w = Window.orderBy("step_no")  # over the few stage rows only
    c = funnel_counts(df, stages)
    return (c.withColumn("_top", F.first("orders").over(w))
            .withColumn("_prev", F.lag("orders").over(w))
            .select("step_no", "stage", "orders",
                    pct_col("orders", "_top").alias("pct_of_placed"),
                    pct_col("orders", "_prev").alias("step_conversion_pct"),
                    (F.col("_prev") - F.col("orders")).alias("dropped_here"))
            .orderBy("step_no").drop("step_no"))


def funnel_shares(df: DataFrame, stages: Sequence[tuple[str, str | None]]) -> DataFrame:
    """Chart form of the funnel: unrounded % of top, step conversion and drop."""
    w = Window.orderBy("step_no")
    c = funnel_counts(df, stages)
    return (c.withColumn("_top", F.first("orders").over(w))
            .withColumn("_prev", F.lag("orders").over(w))
            .select("step_no", "stage", "orders",
                    F.expr("1e2 * CAST(orders AS DOUBLE) / CAST(_top AS DOUBLE)").alias("pct_of_placed"),
                    F.expr("1e2 * CAST(orders AS DOUBLE) / CAST(_prev AS DOUBLE)").alias("step_conv"),
                    (F.col("_prev") - F.col("orders")).alias("dropped"))
            .orderBy("step_no"))


def funnel_timing(df: DataFrame, transitions: Sequence[tuple[str, str, str]], approx: bool = False,
                  accuracy: int = 10000) -> DataFrame:
    """Per transition ``(label, start_ts, end_ts)``: n, median (hours, days), mean, p90.

    Durations are whole minutes; pairs with a missing timestamp and negative
    durations are dropped. One scan: the transitions are unpivoted with
    ``explode``, and the exact quantiles come from counts per (transition, minutes)
    (``value_quantiles``); ``approx=True`` uses fixed-size quantile sketches instead.
    """
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step_no"), F.lit(label).alias("transition"),
                              whole_minutes_col(a, b).alias("mins"))
                     for i, (label, a, b) in enumerate(transitions)])
    long = (df.select(F.explode(rows).alias("t")).select("t.*")
            .filter(F.col("mins").isNotNull() & (F.col("mins") >= 0)))
    dims = ["step_no", "transition"]
    q = _sketched_quantiles(long, dims, "mins", None, accuracy) if approx else value_quantiles(long, dims, "mins")
    g = q.select(*dims, F.col("n").alias("n_orders"), F.col("median").alias("_med"), F.col("p90").alias("_p90"),
                 F.col("total").alias("_sum"))
    return g.select(
        "step_no", "transition", "n_orders",
        F.expr("(SIGN(_med / 6e1) * FLOOR(ABS(_med / 6e1) * 1e1 + 5e-1) / 1e1)").alias("median_hours"),
        F.expr("(SIGN(_med / 1.44e3) * FLOOR(ABS(_med / 1.44e3) * 1e2 + 5e-1) / 1e2)").alias("median_days"),
        avg_exact_col("_sum", "n_orders * 1440", 2).alias("mean_days"),
        F.expr("(SIGN(_p90 / 1.44e3) * FLOOR(ABS(_p90 / 1.44e3) * 1e2 + 5e-1) / 1e2)").alias("p90_days"),
    ).orderBy("step_no").drop("step_no")


def unforced_counts(orders: DataFrame, reviewed: DataFrame, delivered: str) -> DataFrame:
    """Delivered orders, orders with any review row, and reviewed-but-not-delivered; ``reviewed`` holds each reviewed order once."""
    reviewed = reviewed.select("order_id").withColumn("_has", F.lit(True))
    j = orders.select("order_id", delivered).join(reviewed, "order_id", "left")
    has = F.col("_has").isNotNull()
    return j.agg(
        F.count_if(F.col(delivered).isNotNull()).alias("delivered_orders"),
        F.count_if(has).alias("orders_with_review"),
        F.count_if(has & F.col(delivered).isNull()).alias("reviewed_but_not_delivered"))


def value_share(orders: DataFrame, values: DataFrame, dim: str) -> DataFrame:
    """Per ``dim``: distinct orders, value (pre-summed per order) and % of all value."""
    j = orders.select("order_id", dim).join(values, "order_id")
    g = j.groupBy(dim).agg(F.countDistinct("order_id").alias("orders"),
                           F.sum("order_revenue").alias("_v"))
    w = Window.partitionBy()  # over the few dim rows only
    return (g.withColumn("_t", F.sum("_v").over(w))
            .select(dim, "orders", F.col("_v").cast("double").alias("gmv_brl"),
                    pct_col("CAST(_v * 100 AS DECIMAL(38,0))", "CAST(_t * 100 AS DECIMAL(38,0))")
                    .alias("pct_gmv"))
            .orderBy(F.col("gmv_brl").desc(), F.col(dim)))


def quantiles_by(df: DataFrame, dim: str | None, value: str, flag: str | None = None,
                 min_n: int = 0, approx: bool = False, accuracy: int = 10000, bits: int = 2 * STEP_BITS) -> DataFrame:
    """Per ``dim`` (or overall): n, median, p90 (row ceil(0.9 n)), sum and flagged count.

    Exact by default (``bits`` as in ``value_quantiles``); ``approx=True`` uses fixed-size quantile sketches.
    """
    dims = [dim] if dim else []
    g = _sketched_quantiles(df, dims, value, flag, accuracy) if approx else value_quantiles(df, dims, value, flag, bits)
    return g.drop("low_median").filter(F.col("n") >= min_n)


# Truncation formats of the time grains (``trunc``); "day" is the date itself.
GRAINS = {"week": "week", "month": "MM", "quarter": "quarter", "year": "year"}


def _period_col(ts: str, grain: str):
    if grain == "month":
        return month_start_col(ts)
    if grain == "day":
        return F.to_date(ts)
    if grain not in GRAINS:
        raise ValueError(f"grain must be day, {', '.join(GRAINS)}; got {grain!r}")
    return F.trunc(F.col(ts), GRAINS[grain])


def funnel_over_time(df: DataFrame, ts: str, stages: Sequence[tuple[str, str]], days: str,
                     clip: tuple[str, str] | None = None, grain: str = "month") -> DataFrame:
    """Per period of ``ts``: rows, % reaching each nested stage, mean of ``days``.

    ``stages`` is ``[(output column, timestamp column), ...]``; stage k needs the
    timestamps of stages 1..k. ``grain`` is day, week (starting Monday), month,
    quarter or year; the period's first day is in a column named after it.
    """
    conds = _nested_conditions([(name, col) for name, col in stages])
    m = df.withColumn(grain, _period_col(ts, grain))
    if clip:
        m = m.filter(F.col(grain).between(F.to_date(F.lit(clip[0])), F.to_date(F.lit(clip[1]))))
    g = m.groupBy(grain).agg(F.count(F.lit(1)).alias("placed"),
                             *[F.count_if(c).alias(f"_s{i}") for i, c in enumerate(conds)],
                             F.sum(days).alias("_dsum"), F.count(days).alias("_dn"))
    return g.select(grain, "placed",
                    *[pct_col(f"_s{i}", "placed").alias(name) for i, (name, _) in enumerate(stages)],
                    avg_exact_col("_dsum", "_dn", 1).alias("avg_days_to_deliver")).orderBy(grain)


def bucket_outcome(df: DataFrame, rules: Rules, default: str, bucket: str) -> DataFrame:
    """Attach a bucket label from an ordered rule list."""
    return df.withColumn(bucket, case_col(rules, default))


def slope_stats(df: DataFrame, x: str, y_fixed: str) -> DataFrame:
    """Sufficient statistics of a least-squares line, as exact integer sums.

    ``y_fixed`` is the response in fixed-point micro-units; all sums are DECIMAL(38,0).
    """
    d = lambda c: F.col(c).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(d(x)).alias("sx"), F.sum(d(y_fixed)).alias("sy"),
                  F.sum(d(x) * d(y_fixed)).alias("sxy"), F.sum(d(x) * d(x)).alias("sxx"))


def least_squares_slope(df: DataFrame, x: str, y_fixed: str, x_range: tuple[int, int] | None = None,
                        digits: int = 4, y_scale: int = 1_000_000) -> DataFrame:
    """Least-squares slope of y on x and the mean of y, from exact sums.

    ``y_fixed`` is y in fixed point (``y_scale`` units per 1); ``x_range``
    keeps rows with x in the closed range. One partial + final aggregate; the
    slope is NULL when x is constant (or there are fewer than two rows).
    Output: n, slope (rounded half away from zero), mean_y (3 digits).
    """
    if x_range is not None:
        df = df.filter(F.col(x).between(*x_range))
    s = slope_stats(df, x, y_fixed)
    num = "(CAST(n AS DECIMAL(38,0)) * sxy - sx * sy)"
    den = "(CAST(n AS DECIMAL(38,0)) * sxx - sx * sx)"
    slope = f"CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0e0) / CAST({y_scale} AS DOUBLE)"
    return s.select("n", round_col(slope, digits).alias("slope"),
                    avg_exact_col("sy", f"n * {y_scale}", 3).alias("mean_y"))
