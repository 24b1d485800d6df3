"""Global ordering primitives that never put all rows on one task (for NTILE see ``selection``).

``row_number()`` / ``lag()`` over a window *without* PARTITION BY
plan as ``Exchange SinglePartition``: every row goes through one task. Here the
global order is built from a range shuffle instead:

1. ``repartitionByRange(P, keys)`` - Spark samples the composite sort key and cuts
   it into P contiguous, balanced ranges. The key must be unique (append a
   tie-breaker), so even a value held by a third of all rows is split across
   ranges. The partition count is explicit, so AQE does not coalesce it and
   partition ids keep their order.
2. ``sortWithinPartitions`` + ``monotonically_increasing_id``: the id encodes
   (partition << 33) + position in partition.
3. The numbered rows are stored as Parquet in the session's checkpoint dir. Two
   consumers read them, each only the columns it needs: the row counts per
   partition and the final join. Unless they are stored each consumer may get its own range
   exchange (column pruning makes the two subtrees differ, so the exchange is
   not reused), and each exchange samples its own range bounds - the offsets
   would then describe a different partitioning than the rows. Storing them
   also cuts the lineage (chained ranks would otherwise double the plan each
   time) and survives executor loss.
4. Row counts per partition (at most P rows) -> running offsets -> broadcast
   join (size bounded by P, a setting, not by the data).

Per-group numbering and lag (``number_in_group``, ``previous_in_group``) use
the global rank only for hot groups - more rows than an average partition, so
at most P of them - and a plain window for every other group
(``split_hot_groups``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.session import scratch_path
from churnlens.sources.sinks import write_table

_SHIFT = 33


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "rn",
                      total: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row in the global ``order``.

    ``order`` must be a total order (unique key). ``total`` optionally adds the
    row count of the whole frame.
    """
    p = _num_partitions(df, num_partitions)
    path = scratch_path(df.sparkSession, "ranked")
    numbered = (df.repartitionByRange(p, *order).sortWithinPartitions(*order)
                .withColumn("_mid", F.monotonically_increasing_id())
                .withColumn("_part", F.shiftright("_mid", _SHIFT)))
    write_table(numbered, path)
    ranged = df.sparkSession.read.schema(numbered.schema).parquet(path)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy()).alias("_total"))
    out = ranged.join(F.broadcast(offsets), "_part").withColumn(
        name,
        F.col("_offset") + (F.col("_mid") - F.shiftleft(F.col("_part"), _SHIFT)) + F.lit(1))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_mid", "_part", "_offset", "_total")


def split_hot_groups(df: DataFrame, group: str,
                     num_partitions: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(cold rows, hot rows) of ``df`` by the size of their ``group``.

    A group is hot when it holds more rows than an average partition (N / P).
    There are at most P such groups, so the hot-key set is broadcast with a
    bound set by the partition count, not by the data. One job aggregates the
    group sizes (partial aggregation) down to two numbers, N and the largest
    group: when no group is hot, ``(df, None)`` is returned and the caller plans
    no hot path at all. The NULL group is a group like any other: keys are
    compared null-safe, so it is split too when it is hot.
    """
    p = _num_partitions(df, num_partitions)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_gn"))
    total, largest = sizes.agg(F.sum("_gn"), F.max("_gn")).first()
    if not largest or largest * p <= total:
        return df, None
    hot = F.broadcast(sizes.filter(F.col("_gn") * F.lit(p) > F.lit(total)).select(F.col(group).alias("_hot")))
    same = F.col(group).eqNullSafe(F.col("_hot"))
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def number_in_group(df: DataFrame, group: str, order: Sequence[Column], name: str,
                    num_partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by group order by order...)`` that splits hot groups.

    Cold groups (at most an average partition's rows) are numbered by a plain
    window: one shuffle by group. Hot groups are numbered by their global rank
    minus the group's first rank, so a group holding a third of all rows is
    spread over many range partitions. ``order`` must be unique within a group.
    """
    cold, hot = split_hot_groups(df, group, num_partitions)
    cold_n = cold.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint"))
    if hot is None:
        return cold_n
    ranked = global_row_number(hot, [F.col(group)] + list(order), "_grank", num_partitions=num_partitions)
    first = ranked.groupBy(F.col(group).alias("_hot")).agg(F.min("_grank").alias("_gfirst"))  # <= P rows: one per hot group
    hot_n = (ranked.join(F.broadcast(first), F.col(group).eqNullSafe(F.col("_hot")))
             .withColumn(name, F.col("_grank") - F.col("_gfirst") + F.lit(1)).drop("_grank", "_gfirst", "_hot"))
    return cold_n.unionByName(hot_n)


def previous_in_group(df: DataFrame, group: str, order: Sequence[str], value: str,
                      name: str, num_partitions: int | None = None) -> DataFrame:
    """``lag(value) over (partition by group order by order)`` that splits hot groups.

    Cold groups use the window directly. Rows of hot groups are globally ranked
    by (group, order...) - a unique key is required - and each row is joined to
    the row ranked just before it when that row belongs to the same group. A
    group holding a third of the rows is spread over many range partitions
    instead of one window task.
    """
    cold, hot = split_hot_groups(df, group, num_partitions)
    w = Window.partitionBy(group).orderBy(*[F.col(c) for c in order])
    cold_p = cold.withColumn(name, F.lag(value).over(w))
    if hot is None:
        return cold_p
    keys = [F.col(group)] + [F.col(c) for c in order]
    ranked = global_row_number(hot, keys, name="_rn", num_partitions=num_partitions)
    prev = ranked.select(F.col(group).alias("_pg"), (F.col("_rn") + F.lit(1)).alias("_prn"),
                         F.col(value).alias(name))
    hot_p = (ranked.join(prev, (F.col("_rn") == F.col("_prn")) & F.col(group).eqNullSafe(F.col("_pg")), "left")
             .drop("_rn", "_prn", "_pg"))
    return cold_p.unionByName(hot_p)
