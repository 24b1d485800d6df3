"""RFM scoring, segments and two-level review averages on hand-made frames."""

from datetime import date, datetime as dt
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlens.operators import rfm


def _base(spark, n):
    rows = [(f"p{i:03d}", dt(2018, 1, 1 + i % 20), 1 + i % 3, Decimal(f"{10 + (i * 7) % 13}.50")) for i in range(n)]
    return spark.createDataFrame(rows, "person string, last_order_at timestamp_ntz, frequency bigint, "
                                       "monetary decimal(20,2)")


def test_scores_match_sql_ntile_for_small_n(spark):
    snap = spark.createDataFrame([(date(2018, 2, 1),)], "as_of date")
    for n in (1, 2, 3, 4, 6, 7, 8, 9, 23):
        scored = rfm.rfm_score(_base(spark, n), snap)
        raw = _base(spark, n).withColumn("recency_days", F.datediff(F.lit(date(2018, 2, 1)),
                                                                    F.to_date("last_order_at")))
        ref = (raw.withColumn("r", F.ntile(5).over(Window.orderBy(F.col("recency_days").desc(), "person")))
               .withColumn("f", F.ntile(5).over(Window.orderBy("frequency", "person")))
               .withColumn("m", F.ntile(5).over(Window.orderBy("monetary", "person"))))
        bad = scored.join(ref, "person").filter("r_score <> r OR f_score_ntile <> f OR m_score <> m").count()
        assert bad == 0, n
        assert scored.count() == n


def test_threshold_frequency_and_segments(spark):
    df = spark.createDataFrame(
        [("a", 5, 3), ("b", 2, 5), ("c", 3, 1), ("d", 1, 3), ("e", 5, 1), ("f", 1, 1)],
        "person string, r_score int, f_score int").withColumn("f_score_ntile", F.lit(5))
    from churnlens.functions.rules import SEGMENT_DEFAULT, SEGMENT_RULES, case_col
    got = {r.person: r.s for r in df.select("person", case_col(SEGMENT_RULES, SEGMENT_DEFAULT).alias("s")).collect()}
    assert got == {"a": "Loyal Customers", "b": "Cannot Lose Them", "c": "Needs Attention",
                   "d": "At Risk", "e": "New Customers", "f": "Hibernating"}


def test_two_level_review_average(spark):
    po = spark.createDataFrame([("p", "o1"), ("p", "o2"), ("q", "o3"), ("q", "o4")],
                               "person string, order_id string")
    # o1 has two review rows (1 and 2 -> 1.5); o2 one row (5); o3 none; o4 (5, 5)
    scores = spark.createDataFrame([("o1", 3, 2), ("o2", 5, 1), ("o4", 10, 2)],
                                   "order_id string, score_sum bigint, score_n bigint")
    per = {r.person: r for r in rfm.person_scores(po, scores).collect()}
    assert per["p"].reviews == 2 and per["p"].avg_score_u == 3_250_000 and per["p"].any_bad
    assert not per["p"].all_five and per["q"].all_five and per["q"].reviews == 1


def test_scores_exact_on_large_aggregated_base(spark):
    """Large enough that bounds take several passes; the base comes from an aggregate, which must not run anew for each."""
    orders = spark.range(90000).select((F.col("id") % 30011).alias("person_n"), F.col("id").alias("order_id"),
                                       F.expr("timestamp_ntz'2018-01-01 00:00:00' + make_interval(0, 0, 0, "
                                              "CAST(id % 400 AS INT))").alias("ts"),
                                       (F.col("id") % 97 + 1).cast("decimal(10,2)").alias("rev"))
    base = (orders.groupBy(F.col("person_n").cast("string").alias("person"))
            .agg(F.max("ts").alias("last_order_at"), F.countDistinct("order_id").alias("frequency"),
                 F.sum("rev").alias("monetary")))
    snap = spark.createDataFrame([(date(2019, 3, 1),)], "as_of date")
    scored = rfm.rfm_score(base, snap)
    raw = base.withColumn("recency_days", F.datediff(F.lit(date(2019, 3, 1)), F.to_date("last_order_at")))
    ref = (raw.withColumn("r", F.ntile(5).over(Window.orderBy(F.col("recency_days").desc(), "person")))
           .withColumn("f", F.ntile(5).over(Window.orderBy("frequency", "person")))
           .withColumn("m", F.ntile(5).over(Window.orderBy("monetary", "person"))))
    bad = scored.join(ref, "person").filter("r_score <> r OR f_score_ntile <> f OR m_score <> m").count()
    assert bad == 0
