"""Shared derivations over the order model (``churnlens.sources.model.Tables``).

* the person is ``customer_unique_id``: ``customer_id`` is new for every order;
* the valid-order population excludes cancelled / unavailable orders, and NOT IN
  also drops orders whose status is NULL (three-valued logic, as in SQL);
* revenue is price + freight, summed per order *before* any join;
* the snapshot date is the day after the last purchase over all orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.rules import EXCLUDED_STATUSES
from churnlens.sources.model import Tables

TS = "order_purchase_timestamp"


def valid_status(col: str = "order_status") -> Column:
    return ~F.col(col).isin(*EXCLUDED_STATUSES)


def person_orders(t: Tables, valid: bool = True, ts_not_null: bool = True,
                  customer_cols: tuple[str, ...] = ()) -> DataFrame:
    """Orders joined to their customer row, with ``person``.

    The filters are applied to ``orders`` before the join (and reach the scan).
    """
    o = t.orders
    if valid:
        o = o.filter(valid_status())
    if ts_not_null:
        o = o.filter(F.col(TS).isNotNull())
    c = t.customers.select("customer_id", F.col("customer_unique_id").alias("person"), *customer_cols)
    return o.join(c, "customer_id")


def per_order(t: Tables, facts: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``of`` a fact table, which groups it by order, part by part: ordinary orders are bucketed, so grouping them and joining
    the result with bucketed orders takes no shuffle, and hot orders are partially aggregated where they are read."""
    parts = [of(p) for p in t.by_order(facts)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def order_value(t: Tables) -> DataFrame:
    """(order_id, order_revenue): price + freight per order, partially aggregated."""
    return per_order(t, "order_items", lambda items: items.groupBy("order_id").agg(F.sum(F.col("price") + F.col("freight_value")).alias("order_revenue")))


def translated_categories(products: DataFrame, translation: DataFrame, fallback: str = "unknown",
                          collation: str | None = None) -> DataFrame:
    """(product_id, category): the English category name, else the original name,
    else ``fallback``. A left join, so untranslated products are kept; the
    translation is a small dimension (Spark's size-checked broadcast applies).

    ``collation`` compares names by it, in the join and in whatever groups or joins ``category``
    later: ``"UNICODE_CI_AI"`` ignores case and accents, as MySQL's default does."""
    name = F.col("product_category_name")
    if collation:
        name = F.collate(name, collation)
    of = translation.select(name.alias("_name"), "product_category_name_english")
    joined = products.withColumn("_name", name).join(of, "_name", "left")
    category = F.coalesce("product_category_name_english", "product_category_name", F.lit(fallback))
    return joined.select("product_id", (F.collate(category, collation) if collation else category).alias("category"))


def value_by_category(items: DataFrame, categories: DataFrame) -> DataFrame:
    """Per category: products sold, items and value. ``categories`` is (product_id, category), whose collation decides which
    names are one; a group is named by its first spelling, byte by byte."""
    per_product = items.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("price") + F.col("freight_value")).alias("_v"))
    g = per_product.join(categories, "product_id").groupBy("category").agg(
        F.min(F.collate("category", "UTF8_BINARY")).alias("_name"), F.count(F.lit(1)).alias("products"), F.sum("_n").alias("items"), F.sum("_v").alias("_v"))
    return g.select(F.col("_name").alias("category"), "products", "items", F.col("_v").cast("double").alias("value_brl")).orderBy("category")


def snapshot(t: Tables) -> DataFrame:
    """One row: ``as_of`` = date of the last purchase over all orders + 1 day."""
    return t.orders.agg(F.date_add(F.to_date(F.max(TS)), 1).alias("as_of"))


def order_scores(t: Tables) -> DataFrame:
    """(order_id, score_sum, score_n): review rows with a score, per order.

    An order's mean score is ``score_sum / score_n``; operators keep the two
    integers so later averages stay exact.
    """
    return per_order(t, "order_reviews", lambda reviews: (
        reviews.filter(F.col("review_score").isNotNull()).groupBy("order_id")
        .agg(F.sum(F.col("review_score").cast("bigint")).alias("score_sum"), F.count(F.lit(1)).alias("score_n"))))


def first_by(df: DataFrame, group: str, order: list[str], payload: list[str],
             prefix: str = "") -> DataFrame:
    """The first row of each group by ``order`` (ascending, NULLs first), as an aggregate.

    ``min(struct(order..., payload...))`` is a partial (map-side) aggregate, so a
    group with a third of all rows never reaches one task whole, unlike
    ``row_number()`` over a window. ``order`` should end with a unique tie-breaker.
    """
    fields = order + [p for p in payload if p not in order]
    first = F.min(F.struct(*[F.col(c) for c in fields])).alias("_first")
    return df.groupBy(group).agg(first).select(
        group, *[F.col(f"_first.{c}").alias(prefix + c) for c in fields])
