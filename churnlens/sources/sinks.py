"""Sinks: persisted tables, tables of the catalog, and CSV exports of results."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.session import scratch_name, scratch_path


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Persist a frame as Parquet (the analogue of CREATE TABLE AS SELECT)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def replace_table(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """CREATE TABLE AS SELECT into the session's catalog, or a new version of the table; returns it, read by name.

    A version is a table of its own, ``name`` a view on the newest. It is written whole, then counted - rows and size, and
    with ``columns`` their distinct values and ranges - so that the planner knows what it joins, and only then the view is replaced,
    in one step. A rewrite that fails at any point leaves the old version readable by name. The version before stays for queries that
    still read it; older ones are dropped. Files go to the shared scratch folder.
    """
    spark = df.sparkSession
    versions = table_versions(spark, name)
    new = f"{name}__v{max(versions, default=0) + 1:06d}"
    df.write.format("parquet").option("path", scratch_path(spark, name)).saveAsTable(scratch_name(spark, new))
    spark.sql(f"ANALYZE TABLE {new} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(columns)}" if columns else ""))
    spark.sql(f"CREATE OR REPLACE VIEW {scratch_name(spark, name, 'VIEW')} AS SELECT * FROM {new}")
    for v in versions[:-1]:
        spark.sql(f"DROP TABLE IF EXISTS {name}__v{v:06d}")
    return spark.table(name)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """A table of the catalog whose rows stand in ``buckets`` files by ``key``: joins and groups of such tables by the key, with as many
    buckets, need no shuffle. A bucket is read by one task, so keep hot keys elsewhere (``ranking.split_hot_groups``)."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = scratch_name(spark, f"{name}_{uuid.uuid4().hex}")
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def table_versions(spark: SparkSession, name: str) -> list[int]:
    """The versions of a replaceable table that the catalog has, oldest first."""
    tables = (re.fullmatch(re.escape(name) + r"__v(\d{6,})", r["tableName"]) for r in spark.sql(f"SHOW TABLES LIKE '{name}__v*'").collect())
    return sorted(int(m[1]) for m in tables if m)


def export_csv(df: DataFrame, path: str, null_text: str = "NULL") -> None:
    """Export a result as headered CSV with NULL written as text, like the goldens."""
    (df.write.mode("overwrite").option("header", True).option("nullValue", null_text)
       .option("quoteAll", False).csv(path))


def write_csv_table(df: DataFrame, path: str) -> None:
    """Write a table in the reference's CSV layout (header, double-quote enclosed; times as 2017-10-02 10:56:33, with a fraction if they have one)."""
    times = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}
    (df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in times else F.col(f"`{c}`") for c in df.columns]).write.mode("overwrite").option("header", True).option("quote", '"')
       .option("escape", '"').csv(path))
