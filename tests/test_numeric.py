"""Exact rounding helpers agree with exact rational arithmetic and with DuckDB."""

import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import duckdb

from churnlens.functions import numeric as N


def _half_away(fr: Fraction, digits: int) -> float:
    q = Decimal(fr.numerator) / Decimal(fr.denominator)
    sign = -1 if fr < 0 else 1
    return sign * float(abs(Decimal(fr.numerator * 10 ** digits) / Decimal(fr.denominator))
                        .quantize(Decimal(1), rounding=ROUND_HALF_UP)) / 10 ** digits if q else 0.0


def test_pct_and_avg_exact_spark_duckdb(spark):
    rng = random.Random(7)
    rows = [(rng.randint(-5000, 5000), rng.randint(1, 700)) for _ in range(2000)]
    rows += [(1, 8), (1, 16), (201, 20000), (-1, 8), (0, 3), (5, 0)]
    df = spark.createDataFrame(rows, "a bigint, n bigint")
    exprs = {"avg2": N.avg_exact("a", "n", 2, "spark"), "avg1": N.avg_exact("a", "n", 1, "spark"),
             "ir": N.int_round("a", "n", "spark")}
    got = df.selectExpr("a", "n", *[f"{v} AS {k}" for k, v in exprs.items()]).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t(a BIGINT, n BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    dexprs = {"avg2": N.avg_exact("a", "n", 2, "duckdb"), "avg1": N.avg_exact("a", "n", 1, "duckdb"),
              "ir": N.int_round("a", "n", "duckdb")}
    duck = {(r[0], r[1]): r[2:] for r in con.execute(
        "SELECT a, n, " + ", ".join(dexprs.values()) + " FROM t").fetchall()}
    for r in got:
        if r.n == 0:
            assert r.avg2 is None and duck[(r.a, r.n)][0] is None
            continue
        fr = Fraction(r.a, r.n)
        assert r.avg2 == _half_away(fr, 2), (r.a, r.n)
        assert r.avg1 == _half_away(fr, 1), (r.a, r.n)
        assert r.ir == int(_half_away(fr, 0))
        assert (r.avg2, r.avg1, r.ir) == tuple(duck[(r.a, r.n)])


def test_pct_counts(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (3, 752), (0, 5)], "a bigint, n bigint")
    got = [r[0] for r in df.selectExpr(N.pct("a", "n")).collect()]
    assert got == [33.33, 66.67, 0.4, 0.0]


def test_round_half_up_sign(spark):
    got = spark.range(1).selectExpr(N.round_half_up("-2.5e0", 0), N.round_half_up("2.5e0", 0),
                                    N.round_half_up("0.125e0", 2)).first()
    assert tuple(got) == (-3.0, 3.0, 0.13)
