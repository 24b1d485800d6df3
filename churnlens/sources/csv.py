"""CSV loading, load validation and key checks (the reference's load step).

``load_table`` reads a headered, comma-separated, double-quote-enclosed file with
a fixed schema; quoted fields may contain commas, doubled quotes and newlines.
Empty fields of the listed columns become NULL (the loader's NULLIF list).
``rejected_values`` is the load's second output: each value that its column can't
hold, with its line.

Files whose quoted fields hold newlines (``multi_line``) are read by many tasks all the
same: see ``split_records``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Marks a row with a value that its column's type cannot hold (``load_table(strict=False)``).
UNPARSED = "_unparsed"

_FORMAT = {"sep": ",", "quote": '"', "escape": '"'}


#: A range of a file that one task reads: its path and where it begins in it.
_RANGE = ["file", "block"]


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """(range, lines): batches cut where another range begins. A task reads a range's lines in order and one range after the other."""
    for batch in batches:
        if batch.num_rows:
            files, blocks = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
            cuts = (np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1).tolist()
            for i, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                yield (batch.column(0)[i].as_py(), int(blocks[i])), batch.slice(i, end - i)


def _count_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, parity, ends_0, ends_1) of each range: its parity, and how many records end in it if it begins outside or inside a field."""
    own, parity, ends = None, 0, [0, 0]
    row = lambda: pa.RecordBatch.from_arrays([pa.array([v]) for v in (*own, parity, *ends)], [*_RANGE, "parity", "ends_0", "ends_1"])
    for key, lines in _by_range(batches):
        if key != own:
            if own:
                yield row()
            own, parity, ends = key, 0, [0, 0]
        state = (parity + np.cumsum(lines.column(2).to_numpy())) % 2
        inside = int(state.sum())
        parity, ends = int(state[-1]), [ends[0] + len(state) - inside, ends[1] + inside]
    if own:
        yield row()


def _gather(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(file, line, record, text): the records that begin and end in one range, or else (not ``whole``) each range's part of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, line, record, cut, held = None, 0, 0, 0, False, None

        def made(first: Sequence[int], number: Sequence[int], text: pa.Array) -> pa.RecordBatch:
            cols = [pa.repeat(pa.scalar(own[0]), len(text)), pa.array(first, pa.int64()), pa.array(number, pa.int64()), text]
            return pa.RecordBatch.from_arrays(cols, ["file", "line", "record", "text"])

        def left() -> Iterator[pa.RecordBatch]:
            if own and not whole and len(held):                    # goes on in the next range
                yield made([line - len(held)], [record], pc.binary_join(pa.array([held.to_pylist()], pa.list_(pa.string())), "\n"))

        for key, lines in _by_range(batches):
            value, odd, inside, records, before = lines.columns[2:]
            if key != own:
                yield from left()
                own, state, line, record = key, inside[0].as_py(), before[0].as_py() + 1, records[0].as_py()
                cut, held = state == 1, value.slice(0, 0)
            at = line - len(held)                                  # the line of the first value
            held = pa.concat_arrays([held, value])
            states = (state + np.cumsum(odd.to_numpy())) % 2
            state, line = int(states[-1]), line + len(states)
            bounds = np.concatenate([[0], np.flatnonzero(states == 0) + 1 + len(held) - len(states)]).astype(np.int32)
            if len(bounds) > 1:
                texts = pc.binary_join(pa.ListArray.from_arrays(bounds, held), "\n")
                take = slice(int(cut), None) if whole else slice(0, int(cut))
                texts, bounds, held = texts[take], bounds[:-1].astype(np.int64), held.slice(int(bounds[-1]))
                if len(texts):
                    yield made(at + bounds[take], record + np.arange(len(bounds))[take], texts)
                record, cut = record + len(bounds), False
        yield from left()

    return run


def split_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, record): a file's CSV records as text, and the lines (from 1) they begin at; headers and empty records are left out.

    Tasks read byte ranges of a file by lines, so none knows at first whether its range begins within a quoted field. But a doubled
    quote counts twice, so that is settled by parity: an odd number of quotes before a line puts it inside a field. A first reading
    gives each range's parity and how many records end in it, begun inside a field or not; running over the ranges of a file (one
    row each) these give every range its state and the number of its first record. They are few enough to be sent to every
    task of a second reading, which makes records of lines where it reads them. Only what crosses a range's bounds - two parts a range
    - is shuffled and brought together, by record. Quotes must
    stand in quoted fields only; lines end in LF or CR LF, and within a field they stay as they are in the file.
    """
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0).cast("long"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", (quotes % 2).alias("odd"))
    ranges = lines.select(*_RANGE, "odd").mapInArrow(_count_ends, "file string, block long, parity long, ends_0 long, ends_1 long")
    ranges = ranges.withColumn("inside", before("parity") % 2)
    ends = F.when(F.col("inside") == 0, F.col("ends_0")).otherwise(F.col("ends_1"))
    ranges = ranges.select(*_RANGE, "inside", before(ends).alias("records"), before(F.col("ends_0") + F.col("ends_1")).alias("lines"))
    placed = lines.join(F.broadcast(ranges), _RANGE).select(*_RANGE, "value", "odd", "inside", "records", "lines")
    single, parts = (placed.mapInArrow(_gather(whole), "file string, line long, record long, text string") for whole in (True, False))
    longer = parts.groupBy("file", "record").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("parts")).select(
        "file", "line", "record", F.array_join(F.col("parts.text"), "\n").alias("text"))
    return (single.unionByName(longer).filter("record > 0")
            .select("file", "line", F.regexp_replace("text", "\r$", "").alias("record")).filter("record <> ''"))


def _texts(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def _value(name: str, empty: set[str]) -> Column:
    return F.nullif(F.col(f"`{name}`"), F.lit("")) if name in empty else F.col(f"`{name}`")


_RECORD, _WRONG = "_record", "_wrong"


def _records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line, record, one text a column); a record with too few or too many fields keeps only itself, in ``_wrong``."""
    texts = T.StructType([*_texts(schema).fields, T.StructField(_WRONG, T.StringType())])
    parsed = F.from_csv("record", texts.simpleString()[len("struct<"):-1].replace(":", " "),
                        {**_FORMAT, "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _WRONG})
    return split_records(spark, path).select("file", "line", F.col("record").alias(_RECORD), parsed.alias("_p")).select("file", "line", _RECORD, "_p.*")


def load_table(spark: SparkSession, path: str, schema: T.StructType,
               empty_as_null: Iterable[str] = (), multi_line: bool = False, strict: bool = True) -> DataFrame:
    """Read a reference-style CSV export with an explicit schema.

    ``strict`` raises on a value that does not parse; otherwise it becomes NULL and
    the row is marked in ``UNPARSED``. ``multi_line`` files may hold newlines in quoted fields.
    """
    wrong = F.lit(False)
    if multi_line:
        df = _records(spark, path, schema)
        lost = F.col(_WRONG).isNotNull()
        if strict:
            df = df.withColumn(_WRONG, F.when(lost, F.raise_error(F.concat(F.lit("malformed record at line "), F.col("line").cast("string")))))
            lost = F.col(_WRONG).isNotNull()
        wrong = lost
    else:
        df = spark.read.schema(_texts(schema)).options(**_FORMAT, header=True, mode="FAILFAST").csv(path)
    empty = set(empty_as_null)
    cols, bad = [], wrong
    for f in schema.fields:
        c = _value(f.name, empty)
        typed = c.cast(f.dataType) if strict else c.try_cast(f.dataType)
        bad = bad | (c.isNotNull() & typed.isNull())
        cols.append(typed.alias(f.name))
    return df.filter(~wrong).select(*cols) if strict else df.select(*cols, bad.alias(UNPARSED))


def rejected_values(spark: SparkSession, path: str, schema: T.StructType, empty_as_null: Iterable[str] = ()) -> DataFrame:
    """(file, line, column, value, reason): what ``load_table`` can't load.

    One row for each value that its column's type cannot hold; a record with too few or too many fields gives one row without a column and with
    itself as the value. A record is rejected if it has any row here.
    """
    empty = set(empty_as_null)
    row = lambda column, value, reason: F.struct(column.alias("column"), value.alias("value"), reason.alias("reason"))
    whole = F.when(F.col(_WRONG).isNotNull(), row(F.lit(None).cast("string"), F.col(_RECORD), F.lit(f"not {len(schema.fields)} fields")))
    each = []
    for f in schema.fields:
        c = _value(f.name, empty)
        each.append(F.when(F.col(_WRONG).isNull() & c.isNotNull() & c.try_cast(f.dataType).isNull(),
                           row(F.lit(f.name), c, F.lit(f"not {f.dataType.simpleString()}"))))
    return (_records(spark, path, schema).select("file", "line", F.explode(F.array_compact(F.array(whole, *each))).alias("r"))
            .select("file", "line", "r.*"))


def validate_counts(tables: Mapping[str, tuple[DataFrame, int | DataFrame]]) -> DataFrame:
    """One row per table: rows loaded, rows rejected, rows expected, and whether the load matches.

    ``expected`` is an integer literal or a DataFrame whose row count is expected.
    Rows marked ``UNPARSED`` are the rejected ones, which takes reading every column; a load matches
    when all that was expected is loaded, and loaded + rejected = expected tells a bad value from a lost row.
    Each count is a distributed aggregate; the result has one row per table.
    """
    parts = []
    for name, (df, expected) in tables.items():
        marked = F.col(UNPARSED) if UNPARSED in df.columns else F.lit(False)
        counts = df.agg(F.struct(F.count_if(~marked).alias("loaded"), F.count_if(marked).alias("rejected")).alias("n")).scalar()
        if isinstance(expected, DataFrame):
            exp = expected.agg(F.count(F.lit(1))).scalar()
        else:
            exp = F.lit(int(expected)).cast("bigint")
        # one row per table; the counts are scalar subqueries (evaluated once each)
        parts.append(df.sparkSession.range(1).select(F.lit(name).alias("table_name"), counts.alias("n"), exp.alias("expected"))
                     .select("table_name", F.col("n.loaded").alias("rows_loaded"), F.col("n.rejected").alias("rows_rejected"), "expected")
                     .withColumn("matches", F.col("rows_loaded") == F.col("expected")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_key(df: DataFrame, cols: Iterable[str], name: str = "table") -> DataFrame:
    """Primary-key check: rows, distinct non-null keys, rows with a NULL key part,
    keys occurring more than once, and whether the key is a valid primary key."""
    cols = list(cols)
    any_null = F.greatest(*[F.col(c).isNull() for c in cols]) if len(cols) > 1 else F.col(cols[0]).isNull()
    per_key = (df.select(*cols, any_null.alias("_null"))
               .groupBy(*cols, "_null").agg(F.count(F.lit(1)).alias("_n")))
    return per_key.agg(
        F.sum("_n").cast("bigint").alias("rows"),
        F.count_if(~F.col("_null")).cast("bigint").alias("distinct_keys"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).cast("bigint").alias("null_keys"),
        F.count_if(~F.col("_null") & (F.col("_n") > 1)).cast("bigint").alias("duplicated_keys"),
    ).select(F.lit(name).alias("table_name"), F.lit(",".join(cols)).alias("key_columns"), "*",
             ((F.col("null_keys") == 0) & (F.col("duplicated_keys") == 0)).alias("is_primary_key"))
