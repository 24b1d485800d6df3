"""percentile / percentile_disc reproduce the reference's ROW_NUMBER formulas."""

import math

from pyspark.sql import functions as F


def test_median_and_p90_formulas(spark):
    n_max = 300
    df = spark.range(1, n_max + 1).select(F.col("id").alias("n")) \
        .withColumn("x", F.explode(F.sequence(F.lit(1), F.col("n"))))
    got = df.groupBy("n").agg(
        F.percentile("x", F.lit(0.5)).alias("med"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY x)").alias("p90"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").alias("lower")).collect()
    for r in got:
        n = r.n
        mids = {math.floor((n + 1) / 2), math.ceil((n + 1) / 2)}
        assert r.med == sum(mids) / len(mids)
        assert r.p90 == math.ceil(round(0.9 * n, 9))  # row ceil(0.9 n), value = row number
        assert r.lower == math.floor((n + 1) / 2)  # the reference's misplaced-parenthesis median
