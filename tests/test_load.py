"""The load step: a query writes only the model tables that it reads, and raw files come before the model."""

import datetime
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from churnlens.plans import catalog
from churnlens.sources import binding, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture
def new_dir():
    """An input folder that no query has read yet."""
    d = tempfile.mkdtemp(prefix="load-")
    for t in ("orders", "customer", "nation", "part", "supplier", "lineitem"):
        shutil.copy(f"{SF}/{t}.parquet", os.path.join(d, f"{t}.parquet"))
    return d


@pytest.mark.parametrize("key", ["load_validation", "load_rejected", "load_csv"])
def test_raw_files_need_no_model(spark, new_dir, key, monkeypatch):
    want = sorted(map(str, catalog.queries()[key](spark, SF).collect()))

    def loaded(*_):
        raise AssertionError("the model is loaded")

    monkeypatch.setattr(binding, "model_tables", loaded)
    assert sorted(map(str, catalog.queries()[key](spark, new_dir).collect())) == want


def test_a_query_loads_what_it_reads(spark, new_dir, monkeypatch):
    written = []
    for name in ("write_bucketed", "write_table"):
        def note(df, at, *rest, _of=getattr(sinks, name)):
            written.append(at)
            return _of(df, at, *rest)
        monkeypatch.setattr(sinks, name, note)
    got = catalog.queries()["matched_window_by_year"](spark, new_dir).collect()
    assert got == catalog.queries()["matched_window_by_year"](spark, SF).collect()
    of_new = [w for w in written if "items" in w or "reviews" in w or "payments" in w]
    assert written and not of_new, written
    assert len(binding.model_tables(spark, new_dir).as_dict()) == 8
    assert sum("items" in w for w in written) == 1                              # and once


def test_times_keep_their_fraction(spark):
    when = [datetime.datetime(2018, 1, 2, 3, 4, 5), datetime.datetime(2018, 1, 2, 3, 4, 5, 123456), None]
    d = tempfile.mkdtemp(prefix="times-") + "/t"
    sinks.write_csv_table(spark.createDataFrame([(i, t) for i, t in enumerate(when)], "i int, t timestamp_ntz").coalesce(1), d)
    assert sorted(r.value for r in spark.read.text(d).collect()) == ["0,2018-01-02 03:04:05", "1,2018-01-02 03:04:05.123456", "2,", "i,t"]
    back = spark.read.schema("i int, t string").option("header", True).csv(d).select("i", F.col("t").cast("timestamp_ntz").alias("t"))
    assert [r.t for r in back.orderBy("i").collect()] == when
