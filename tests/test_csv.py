"""The CSV loader: quoting, embedded newlines, doubled quotes, empty -> NULL; rejected values; key checks."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.sources import csv
from churnlens.sources.model import SCHEMAS

TEXT = (
    'review_id,order_id,review_score,review_comment_title,review_comment_message,'
    'review_creation_date,review_answer_timestamp\n'
    'r1,o1,5,,"great, fast",2018-01-02 00:00:00,2018-01-03 10:00:00\n'
    'r2,o1,1,"bad","line one\nline two ""quoted""",,\n'
    'r1,o2,,"",plain,2018-02-01 00:00:00,\n'
)


def test_load_table_csv_rules(spark):
    d = tempfile.mkdtemp(prefix="csvtest-")
    with open(os.path.join(d, "reviews.csv"), "w") as f:
        f.write(TEXT)
    schema = T.StructType([T.StructField("review_id", T.StringType()), T.StructField("order_id", T.StringType()),
                           T.StructField("review_score", T.ByteType()),
                           T.StructField("review_comment_title", T.StringType()),
                           T.StructField("review_comment_message", T.StringType()),
                           T.StructField("review_creation_date", T.TimestampNTZType()),
                           T.StructField("review_answer_timestamp", T.TimestampNTZType())])
    df = csv.load_table(spark, d, schema, ["review_comment_title", "review_comment_message",
                                          "review_creation_date", "review_answer_timestamp"], multi_line=True)
    rows = {(r.review_id, r.order_id): r for r in df.collect()}
    assert len(rows) == 3
    a, b, c = rows[("r1", "o1")], rows[("r2", "o1")], rows[("r1", "o2")]
    assert a.review_comment_message == "great, fast" and a.review_comment_title is None
    assert b.review_comment_message == 'line one\nline two "quoted"' and b.review_score == 1
    assert b.review_creation_date is None
    assert c.review_score is None and c.review_comment_title is None
    keys = csv.check_key(df, ["review_id"], "order_reviews").first()
    assert (keys.rows, keys.distinct_keys, keys.duplicated_keys, keys.is_primary_key) == (3, 2, 1, False)


def test_validate_counts(spark):
    df = spark.range(5)
    out = {r.table_name: (r.rows_loaded, r.expected, r.matches)
           for r in csv.validate_counts({"a": (df, 5), "b": (df, 6), "c": (df, spark.range(5))}).collect()}
    assert out == {"a": (5, 5, True), "b": (5, 6, False), "c": (5, 5, True)}


def _file(text, name="t.csv", d=None):
    d = d or tempfile.mkdtemp(prefix="csvtest-")
    with open(os.path.join(d, name), "w", newline="") as f:
        f.write(text)
    return d


@pytest.fixture
def cut_at(spark):
    """Read files in ranges of so many bytes."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


ABC = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])


def _by_spark(spark, path):
    """Spark's own reader, one task a file."""
    return sorted(map(tuple, spark.read.schema(ABC).options(header=True, quote='"', escape='"', multiLine=True).csv(path).collect()), key=str)


def _by_ranges(spark, path):
    return sorted(map(tuple, csv.load_table(spark, path, ABC, multi_line=True).collect()), key=str)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_cut_anywhere_read_as_the_whole_file(spark, cut_at, end):
    """Every byte is a cut: within quotes, doubled quotes, line ends and characters of several bytes."""
    text = end.join(['a,b,c', f'1,"x{end}y ""z""{end}{end}end","{end}"', '2,,""', '"""",éü,""""""', '3,"p,q",', '', f'4,"日本{end}語",end']) + end
    d = _file(text)
    want = _by_spark(spark, d)
    assert len(want) == 5
    for n in (1, 2, 3, 7, 1000):
        cut_at(n)
        got = _by_ranges(spark, d)
        if end == "\r\n":                                                       # Spark's reader makes LF of a field's line ends
            assert any("\r\n" in v for r in got for v in r if v)
            got = [tuple(v and v.replace("\r\n", "\n") for v in r) for r in got]
        assert got == want, n


def test_random_files(spark, cut_at):
    rng = random.Random(8)
    field = lambda: "".join(rng.choice(['a', '1', ',', '""', "\n", "é", " "]) for _ in range(rng.randint(0, 6)))
    d = None
    for i in range(3):                                                          # files of a folder, each with its header
        text = "a,b,c\n" + "".join(",".join(f'"{field()}"' if rng.random() < 0.7 else str(rng.randint(0, 99)) for _ in range(3)) + "\n" for _ in range(60))
        d = _file(text if i else text[:-1], f"t{i}.csv", d)
    want = _by_spark(spark, d)
    assert len(want) == 180
    for n in (37, 400):
        cut_at(n)
        assert _by_ranges(spark, d) == want
        lines = {(r.file[-6:], r.line) for r in csv.split_records(spark, d).collect()}
        assert len(lines) == 180 and min(n for _, n in lines) == 2


def test_a_file_is_read_by_many_tasks(spark, cut_at):
    d = _file("a,b,c\n" + '"x\ny",2,3\n' * 500)
    cut_at(500)
    read = csv.split_records(spark, d)
    assert read.count() == 500
    assert spark.read.option("lineSep", "\n").text(d).rdd.getNumPartitions() > 4


def test_rejected_values_by_type(spark):
    kinds = {"i": T.IntegerType(), "y": T.ByteType(), "m": T.DecimalType(5, 2), "d": T.DateType(), "t": T.TimestampNTZType(), "s": T.StringType(), "x": T.DoubleType(), "b": T.BooleanType()}
    schema = T.StructType([T.StructField(c, k) for c, k in kinds.items()])
    good = "1,2,3.25,2018-01-02,2018-01-02 03:04:05,any,1e3,true"
    bad = {"i": "1x", "y": "300", "m": "1234.5", "d": "2018-13-01", "t": "noon", "x": "1,5", "b": "perhaps"}
    lines = ["i,y,m,d,t,s,x,b", good]
    for c, v in bad.items():
        lines.append(",".join(f'"{v}"' if k == c else x for k, x in zip(kinds, good.split(","))))
    lines += [good, '1,2,3.25,2018-01-02,2018-01-02 03:04:05,"two', 'lines",1e3,nope', "1,2", good + ",more", ",,,,,,,", '9 9,2,x,2018-01-02,2018-01-02 03:04:05,"",1,true']
    d = _file("\n".join(lines) + "\n")
    null = tuple(kinds)
    got = sorted((r.line, r.column, r.value, r.reason) for r in csv.rejected_values(spark, d, schema, null).fillna("", ["column"]).collect())
    first = [(3 + i, c, v, f"not {kinds[c].simpleString()}") for i, (c, v) in enumerate(bad.items())]
    at = 3 + len(bad)
    assert got == sorted([*first, (at + 1, "b", "nope", "not boolean"), (at + 3, "", "1,2", "not 8 fields"), (at + 4, "", good + ",more", "not 8 fields"),
                          (at + 6, "i", "9 9", "not int"), (at + 6, "m", "x", "not decimal(5,2)")])
    rows = csv.load_table(spark, d, schema, null, multi_line=True, strict=False)
    assert rows.filter(csv.UNPARSED).count() == len({line for line, *_ in got})
    counts = csv.validate_counts({"t": (rows, 14)}).first()
    assert (counts.rows_loaded, counts.rows_rejected, counts.matches) == (3, 11, False)
    assert counts.rows_loaded + counts.rows_rejected == counts.expected
    with pytest.raises(Exception, match="line|CAST|cast"):
        csv.load_table(spark, d, schema, null, multi_line=True).collect()


def test_files_without_newlines_in_fields_lose_nothing(spark):
    d = _file("a,b,c\n1,2,3\n4,5,6")
    assert csv.load_table(spark, d, ABC, multi_line=True).count() == 2
    assert csv.load_table(spark, _file("a,b,c\n"), ABC, multi_line=True).count() == 0
    assert csv.split_records(spark, d).select(F.max("line")).first()[0] == 3


def test_a_value_that_does_not_parse_fails_the_validation(spark):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    d = _file("id,n\na,1\nb,notanumber\nc,\n")
    back = csv.load_table(spark, d, schema, ["n"], strict=False)
    r = csv.validate_counts({"t": (back, 3)}).first()
    assert (r.rows_loaded, r.expected, r.matches) == (2, 3, False)


def test_geolocation_loads_with_its_declared_schema(spark):
    d = _file("geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n"
              "01037,-23.54562128,-46.63929204,sao paulo,SP\n01037,-23.54562128,-46.63929204,sao paulo,SP\n")
    df = csv.load_table(spark, d, SCHEMAS["geolocation"])
    assert df.schema["geolocation_lat"].dataType == T.DecimalType(11, 8)
    assert [str(r.geolocation_lat) for r in df.collect()] == ["-23.54562128"] * 2
    assert csv.validate_counts({"geolocation": (csv.load_table(spark, d, SCHEMAS["geolocation"], strict=False), 2)}).first().matches


def test_lines_are_not_shuffled(spark, cut_at):
    """What is read of a file reaches an exchange only as a row a range, or as the parts of records that cross a range's bounds."""
    d = _file("a,b,c\n" + '"x\ny",2,3\n' * 500)
    plan = csv.load_table(spark, d, ABC, multi_line=True)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    scans = [i for i, line in enumerate(plan) if "FileScan text" in line]
    assert scans
    for i in scans:
        above, at = [], depth(plan[i])
        for line in reversed(plan[:i]):
            if depth(line) < at:
                above.append(line)
                at = depth(line)
        kinds = [next((k for k in ("MapInArrow", "Exchange") if k in line), "") for line in above]
        assert "MapInArrow" in kinds and "Exchange" not in kinds[:kinds.index("MapInArrow")], above
    cut_at(400)
    assert csv.split_records(spark, d).filter("record = '\"x\ny\",2,3'").count() == 500


def test_a_record_over_many_ranges(spark, cut_at):
    """A field that is longer than several ranges, batches of few lines, and a file that ends within a field."""
    d = _file("a,b,c\n" + '1,"' + "line\n" * 300 + '",3\n4,5,6\n7,"open\nend')
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for n in (64, 100_000):
            cut_at(n)
            rows = sorted((r.line, r.record) for r in csv.split_records(spark, d).collect())
            assert rows == [(2, '1,"' + "line\n" * 300 + '",3'), (303, "4,5,6"), (304, '7,"open\nend')]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
