"""Recency / frequency / monetary scoring, segments and their cuts.

Scores are SQL ``NTILE(5)`` over all persons. A global NTILE normally sorts them all
in a single task; here ``selection.ntiles`` finds the tiles' bounds by counting, for
all scores together, and compares every person with them. The person id is appended to
every key so ties are broken the same way in every run. 5 is always the good end:
recency is tiled descending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.numeric import avg_exact_col, int_round_col, pct_col, to_fixed_col
from churnlens.functions.rules import (F_SCORE_DEFAULT, F_SCORE_RULES, SEGMENT_DEFAULT, SEGMENT_RULES,
                                       Rules, case_col)
from churnlens.operators.selection import ntiles
from churnlens.session import scratch_path
from churnlens.sources.sinks import write_table


def _cents(c: str) -> str:
    return f"CAST({c} * 100 AS DECIMAL(38,0))"


def rfm_base(person_orders: DataFrame, values: DataFrame, entity: str = "person",
             ts: str = "order_purchase_timestamp") -> DataFrame:
    """Per person: first and last order time, distinct orders, revenue (> 0 only).

    Order revenue is joined already summed per order (no item fan-out). The
    first order time rides along in the same aggregate, so tenure cuts read it
    from the persisted scores instead of aggregating all orders again.
    """
    j = person_orders.select(entity, "order_id", ts).join(values, "order_id", "left")
    base = j.groupBy(entity).agg(
        F.min(ts).alias("first_order_at"),
        F.max(ts).alias("last_order_at"),
        F.countDistinct("order_id").alias("frequency"),
        F.coalesce(F.sum("order_revenue"), F.lit(0)).alias("monetary"))
    return base.filter(F.col("monetary") > 0)


def rfm_score(base: DataFrame, snapshot: DataFrame, entity: str = "person", n: int = 5,
              rules: Rules = SEGMENT_RULES, default: str = SEGMENT_DEFAULT) -> DataFrame:
    """Score persons: recency days to the snapshot, three NTILE(n) scores, the
    threshold frequency score, the score cell, the first matching segment, and the
    value quintile (tile 1 = top) of ``pareto``. The unscored persons are stored once: the bounds of
    the tiles are counted from them in a few passes."""
    as_of = snapshot.select("as_of").scalar()  # one-row aggregate as a scalar subquery
    extra = ["first_order_at"] if "first_order_at" in base.columns else []
    raw = base.select(
        entity, F.datediff(as_of, F.to_date("last_order_at")).alias("recency_days"),
        "frequency", "monetary", *extra)
    path = scratch_path(base.sparkSession, "unscored")
    write_table(raw, path)
    tie = (entity, True)
    scored = ntiles(base.sparkSession.read.schema(raw.schema).parquet(path), {
        "r_score": (n, [("recency_days", False), tie]), "f_score_ntile": (n, [("frequency", True), tie]),
        "m_score": (n, [("monetary", True), tie]), "value_quintile": (n, [("monetary", False), tie])})
    scored = scored.withColumn("f_score", case_col(F_SCORE_RULES, F_SCORE_DEFAULT).cast("int"))
    return scored.select(
        entity, "recency_days", "frequency", "monetary", "r_score", "f_score_ntile", "f_score", "m_score",
        F.concat(F.col("r_score").cast("string"), F.col("f_score").cast("string"),
                 F.col("m_score").cast("string")).alias("rfm_cell"),
        case_col(rules, default).alias("segment"), "value_quintile", *extra)


def segment_summary(rfm: DataFrame, segment: str = "segment", frequency_digits: int = 2,
                    with_recency: bool = True) -> DataFrame:
    """Per segment: customers, % customers, revenue, % revenue, averages."""
    g = rfm.groupBy(segment).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("_rev"),
        F.sum("recency_days").alias("_rsum"), F.sum("frequency").alias("_fsum"))
    w = Window.partitionBy()  # over the few segment rows only
    g = g.withColumn("_tc", F.sum("customers").over(w)).withColumn("_tr", F.sum("_rev").over(w))
    cols = [segment, "customers", pct_col("customers", "_tc").alias("pct_customers"),
            F.col("_rev").cast("double").alias("revenue_brl"),
            pct_col(_cents("_rev"), _cents("_tr")).alias("pct_revenue")]
    if with_recency:
        cols += [avg_exact_col("_rev", "customers", 2).alias("avg_value_brl"),
                 int_round_col("_rsum", "customers").alias("avg_recency_days")]
    cols.append(avg_exact_col("_fsum", "customers", frequency_digits).alias("avg_frequency"))
    return g.select(*cols).orderBy(F.col("revenue_brl").desc(), F.col(segment))


def tile_diagnostic(rfm: DataFrame, tile: str, value: str) -> DataFrame:
    """Per tile: members and the min / max of the tiled value (shows tie splits)."""
    return (rfm.groupBy(tile).agg(F.count(F.lit(1)).alias("customers"),
                                  F.min(value).alias("min_freq"), F.max(value).alias("max_freq"))
            .orderBy(tile))


def pareto(rfm: DataFrame, value: str = "monetary", entity: str = "person", n: int = 5) -> DataFrame:
    """Value by descending value quintile (tile 1 = top) and its share of the total; scored persons carry theirs."""
    t = rfm if "value_quintile" in rfm.columns else ntiles(rfm.select(entity, value), {"value_quintile": (n, [(value, False), (entity, True)])})
    g = t.groupBy("value_quintile").agg(F.count(F.lit(1)).alias("customers"), F.sum(value).alias("_v"))
    w = Window.partitionBy()
    return (g.withColumn("_t", F.sum("_v").over(w))
            .select(F.col("value_quintile").cast("bigint").alias("value_quintile"), "customers",
                    F.col("_v").cast("double").alias("revenue_brl"),
                    pct_col(_cents("_v"), _cents("_t")).alias("pct_revenue"))
            .orderBy("value_quintile"))


def top_categories(persons: DataFrame, person_orders: DataFrame, items: DataFrame,
                   categories: DataFrame, min_n: int = 100, k: int = 15,
                   entity: str = "person") -> DataFrame:
    """Categories bought by the given persons: one row per (person, category),
    groups of at least ``min_n``, top ``k`` by buyers.

    ``persons`` is (person, monetary); ``categories`` is (product_id, category).
    Pairs are de-duplicated at (person, product) before the category lookup so
    repeated purchases never fan out.
    """
    po = person_orders.select(entity, "order_id").join(persons.select(entity), entity, "left_semi")
    pp = po.join(items.select("order_id", "product_id"), "order_id").select(entity, "product_id").distinct()
    pc = pp.join(categories, "product_id").select(entity, "category").distinct()
    d = pc.join(persons, entity)
    g = d.groupBy("category").agg(F.count(F.lit(1)).alias("high_value_customers"),
                                  F.sum("monetary").alias("_v"))
    return (g.filter(F.col("high_value_customers") >= min_n)
            .select("category", "high_value_customers",
                    avg_exact_col("_v", "high_value_customers", 2).alias("avg_customer_brl"),
                    F.col("_v").cast("double").alias("total_value_brl"))
            .orderBy(F.col("high_value_customers").desc(), F.col("category")).limit(k))


def agreement(rfm: DataFrame, rules_a: Rules, default_a: str, rules_b: Rules, default_b: str,
              names: tuple[str, str] = ("rule_based", "ntile_based")) -> DataFrame:
    """Cross-tabulation of two labellings of the same persons."""
    a, b = names
    return (rfm.select(case_col(rules_a, default_a).alias(a), case_col(rules_b, default_b).alias(b))
            .groupBy(a, b).agg(F.count(F.lit(1)).alias("customers"))
            .orderBy(F.col("customers").desc(), a, b))


def with_tenure(rfm: DataFrame, first: DataFrame | None, snapshot: DataFrame, entity: str = "person") -> DataFrame:
    """Add tenure_days (first order to the snapshot) to each scored person.

    ``first`` is (person, first_order_at), or None when ``rfm`` already carries
    ``first_order_at`` (as the persisted scores do). ``snapshot`` is a one-row
    frame (``as_of``), used as a scalar subquery.
    """
    as_of = snapshot.select("as_of").scalar()
    with_first = rfm if first is None else rfm.join(first, entity)
    return with_first.withColumn("tenure_days", F.datediff(as_of, F.to_date("first_order_at")))


def tenure_summary(rfm_tenure: DataFrame, bucket: str = "tenure_bucket") -> DataFrame:
    """Per (segment, tenure bucket): customers and average F, M, R."""
    g = rfm_tenure.groupBy("segment", bucket).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("frequency").alias("_f"),
        F.sum("monetary").alias("_m"), F.sum("recency_days").alias("_r"))
    return g.select("segment", bucket, "customers",
                    avg_exact_col("_f", "customers", 2).alias("avg_frequency"),
                    avg_exact_col("_m", "customers", 2).alias("avg_value_brl"),
                    int_round_col("_r", "customers").alias("avg_recency_days")).orderBy("segment", bucket)


def value_by_label(df: DataFrame, label: str) -> DataFrame:
    """Per label: persons, total value and mean value."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("_m"))
    return g.select(label, "customers", F.col("_m").cast("double").alias("revenue_brl"),
                    avg_exact_col("_m", "customers", 2).alias("avg_value_brl")).orderBy(label)


def person_scores(person_orders: DataFrame, scores: DataFrame, entity: str = "person") -> DataFrame:
    """Two-level review score per person: order mean first, then person mean.

    Per person: number of reviewed orders, mean of order means (fixed-point
    micro-units), whether any order mean is <= 2 and whether all are >= 5.
    """
    j = person_orders.select(entity, "order_id").join(scores, "order_id")
    j = j.withColumn("_u", to_fixed_col("score_sum", "score_n"))
    g = j.groupBy(entity).agg(
        F.count(F.lit(1)).alias("reviews"), F.sum("_u").alias("_su"),
        F.bool_or(F.col("score_sum") <= F.col("score_n") * 2).alias("any_bad"),
        F.bool_and(F.col("score_sum") >= F.col("score_n") * 5).alias("all_five"))
    return g.select(entity, "reviews", int_round_col("_su", "reviews").alias("avg_score_u"),
                    "any_bad", "all_five")


def review_by_segment(rfm: DataFrame, per_person: DataFrame, entity: str = "person") -> DataFrame:
    """Per segment: persons with reviews, mean score, % ever <= 2, % always 5."""
    j = rfm.select(entity, "segment").join(per_person, entity)
    g = j.groupBy("segment").agg(F.count(F.lit(1)).alias("customers_with_reviews"),
                                 F.sum("avg_score_u").alias("_su"),
                                 F.count_if("any_bad").alias("_bad"), F.count_if("all_five").alias("_five"))
    return g.select("segment", "customers_with_reviews",
                    avg_exact_col("_su", "customers_with_reviews * 1000000", 3).alias("avg_review_score"),
                    pct_col("_bad", "customers_with_reviews").alias("pct_with_bad_review"),
                    pct_col("_five", "customers_with_reviews").alias("pct_all_five_star"),
                    ).orderBy("avg_review_score", "segment")
