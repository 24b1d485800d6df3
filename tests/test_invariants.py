"""Invariants of the registered queries on the sf0.01 driver tables, plus approximate quantiles."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from churnlens.operators import funnel

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _q(spark, key):
    return E.queries()[key](spark, SF).toPandas()


def test_funnel_is_monotone(spark):
    for key in ("funnel_nested", "funnel_events"):
        f = _q(spark, key)
        assert list(f["orders"]) == sorted(f["orders"], reverse=True)
        assert (f["dropped_here"].iloc[1:] >= 0).all()


def test_month_zero_is_everyone(spark):
    g = _q(spark, "cohort_retention")
    m0 = g[g.month_index == 0]
    assert (m0.pct_retained == 100.0).all() and (m0.active_customers == m0.cohort_size).all()
    assert (g.active_customers <= g.cohort_size).all()


def test_tiles_are_balanced(spark):
    r = _q(spark, "rfm_customers")
    for tile in ("r_score", "f_score_ntile", "m_score"):
        sizes = r.groupby(tile).size()
        assert sizes.sum() == len(r) and sizes.max() - sizes.min() <= 1 and list(sizes.index) == [1, 2, 3, 4, 5]


def test_shares_sum_to_100(spark):
    s = _q(spark, "segment_shares")
    assert abs(s.pct_customers.sum() - 100) < 1e-9 and abs(s.pct_revenue.sum() - 100) < 1e-9
    p = _q(spark, "pareto")
    assert abs(p.pct_revenue.sum() - 100) < 0.05 and p.customers.sum() == len(_q(spark, "rfm_customers"))


def test_approx_quantiles_close_to_exact(spark):
    df = spark.range(20000).select((F.col("id") * 7919 % 10007).alias("v"), (F.col("id") % 3).alias("g"))
    exact = {r.g: r for r in funnel.quantiles_by(df, "g", "v").collect()}
    approx = {r.g: r for r in funnel.quantiles_by(df, "g", "v", approx=True).collect()}
    for g in exact:
        assert abs(exact[g].median - approx[g].median) <= 10007 * 0.002
        assert abs(exact[g].p90 - approx[g].p90) <= 10007 * 0.002
