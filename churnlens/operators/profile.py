"""Orientation and profiling operators (date range, category shares, key identity,
join fan-out)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.numeric import pct_col


def date_bounds(df: DataFrame, ts: str) -> DataFrame:
    """First and last value of a timestamp column."""
    return df.agg(F.min(ts).alias("first_order"), F.max(ts).alias("last_order"))


def share_by(df: DataFrame, dim: str, count_name: str = "n", pct_name: str = "pct") -> DataFrame:
    """Rows per value of ``dim`` and their % of all rows (window over the small result)."""
    g = df.groupBy(dim).agg(F.count(F.lit(1)).alias(count_name))
    return (g.withColumn("_t", F.sum(count_name).over(Window.partitionBy()))
            .select(dim, count_name, pct_col(count_name, "_t").alias(pct_name))
            .orderBy(F.col(count_name).desc(), F.col(dim)))


def key_profile(df: DataFrame, cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Row count and distinct count of each column (is a column a per-row key?)."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.countDistinct(c).alias(n) for c, n in zip(cols, names)])


def fanout(start: DataFrame, start_key: str,
           steps: Sequence[tuple[str, DataFrame, str, str | None]],
           start_name: str = "start") -> DataFrame:
    """Row counts after each successive inner join, to spot fan-out or loss.

    ``steps`` is ``[(name, frame, join key, next key or None), ...]``: step i joins
    ``frame`` on ``join key`` (a column of the rows so far and of ``frame``) and
    the following step joins on ``next key``, a column of ``frame``.

    The joins are never materialised. The chain is folded from its end: each frame is reduced to
    its join key with the rows that one row of that key becomes after this step and after every later
    one, so an intermediate holds at most one row per key. One lazy plan; every frame is read
    once, and each join finds its right side already dealt out by the join key. A step
    that loses every row reports 0; NULL keys join nothing.
    """
    below: DataFrame | None = None
    counts: list[str] = []
    for i in range(len(steps) - 1, -1, -1):
        _, frame, key, nxt = steps[i]
        rows = frame.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), *([F.col(nxt).alias("_n")] if below is not None else []))
        if below is not None:
            rows = rows.join(below.withColumnRenamed("_k", "_n"), "_n", "left")
        below = rows.groupBy("_k").agg(F.count(F.lit(1)).alias(f"_c{i}"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
        counts = [f"_c{i}", *counts]
    top = start.select(F.col(start_key).alias("_k"))
    top = top if below is None else top.join(below, "_k", "left")
    wide = top.agg(F.count(F.lit(1)).alias("_c"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    rows = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("step_no"), F.lit(n).alias("stage"), F.col(c).cast("bigint").alias("rows"))
                     for i, (n, c) in enumerate(zip([start_name] + [s[0] for s in steps], ["_c", *counts]))])
    return wide.select(F.explode(rows).alias("r")).select("r.*").orderBy("step_no")
