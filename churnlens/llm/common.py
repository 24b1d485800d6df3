"""Helpers shared by the operators of this package."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import scratch_dir, scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One driver table, read whole."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, **cols: str) -> DataFrame:
    """``df`` reduced to the named columns; every other column, whatever its name, is left behind."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in cols.items()])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared scratch folder and read back.

    Cuts lineage with files every executor can read, so a lost executor costs no recomputation
    of what stands before, and two consumers see the same rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_scratch(spark: SparkSession) -> None:
    """Make sure that ``checkpoint()`` has its (shared) folder."""
    scratch_dir(spark)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc32_text(col: Column) -> Column:
    """crc32 of a value's decimal text."""
    return F.crc32(col.cast("string").cast("binary"))


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b)


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into pieces of ``rows`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
