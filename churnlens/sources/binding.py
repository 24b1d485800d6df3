"""Bind the driver's TPC-H-style tables to the order model.

The reference analyses an e-commerce order model; the test data is a TPC-H-like
star schema. Each model table is derived from whole driver tables by one set of
SQL expressions, rendered for Spark (the operators' input) and for DuckDB (the
oracle's input), so both engines see identical rows:

* orders: one row per TPC-H order; ``customer_id`` is new per order (as in the
  reference), the person is ``o_custkey``; status and the five stage timestamps
  are derived from the order key so that every edge case occurs (missing stages,
  stages out of order, late and early deliveries, missing estimates).
* customers: one row per order, with the state taken from the nation (shifted
  for every tenth order, so persons can have several states).
* order_items: lineitem rows; the item number is recomputed per order because
  (l_orderkey, l_linenumber) is not unique in the test data.
* order_reviews: one review row per lineitem (several rows per order).
* products: category = first word of the part type, NULL for size 50.
* category_translation: a five-row dimension; PROMO stays untranslated.
* order_payments: one payment per order; sellers: the suppliers, state from the nation.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import scratch_cache, scratch_path
from churnlens.sources import sinks
from churnlens.sources.model import StoredTables, Tables

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def _t(minutes: str, dialect: str) -> str:
    """o_orderdate plus a number of minutes."""
    if dialect == "spark":
        return f"timestampadd(MINUTE, {minutes}, o_orderdate)"
    return f"(o_orderdate + to_minutes({minutes}))"


def orders_exprs(dialect: str) -> list[str]:
    k = "o_orderkey"
    t = lambda m: _t(m, dialect)
    return [
        f"{k} AS order_id",
        f"{k} AS customer_id",
        (f"CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'shipped' "
         f"WHEN {k} % 2 = 0 THEN 'canceled' ELSE 'unavailable' END AS order_status"),
        f"CASE WHEN {k} % 211 = 0 THEN NULL ELSE {t(f'{k} % 1440')} END AS order_purchase_timestamp",
        (f"CASE WHEN {k} % 97 = 0 THEN NULL ELSE {t(f'{k} % 1440 + ({k} * 37) % 4320 - 60')} END "
         f"AS order_approved_at"),
        (f"CASE WHEN {k} % 53 = 0 THEN NULL ELSE "
         f"{t(f'{k} % 1440 + ({k} * 37) % 4320 + ({k} * 61) % 10080')} END AS order_delivered_carrier_date"),
        (f"CASE WHEN {k} % 31 = 0 THEN NULL ELSE "
         f"{t(f'{k} % 1440 + ({k} * 37) % 4320 + ({k} * 61) % 10080 + ({k} * 89) % 30240')} END "
         f"AS order_delivered_customer_date"),
        f"CASE WHEN {k} % 101 = 0 THEN NULL ELSE {t('20160')} END AS order_estimated_delivery_date",
    ]


STATE_NATION_KEY = "(c.c_nationkey + CASE WHEN o.o_orderkey % 10 = 0 THEN 1 ELSE 0 END) % 25"

ITEMS_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice"


def items_exprs(dialect: str) -> list[str]:
    return [
        "l_orderkey AS order_id",
        f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ITEMS_ORDER}) AS INT) AS order_item_id",
        "l_partkey AS product_id",
        "l_suppkey AS seller_id",
        "l_shipdate AS shipping_limit_date",
        "CAST(l_extendedprice AS DECIMAL(10,2)) AS price",
        "CAST(l_quantity AS DECIMAL(10,2)) AS freight_value",
    ]


def reviews_exprs(dialect: str) -> list[str]:
    nl = "chr(10)"
    return [
        "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS review_id",
        "l_orderkey AS order_id",
        "CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE CAST(1 + CAST(l_quantity AS INT) % 5 AS TINYINT) END "
        "AS review_score",
        "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('line ', CAST(l_linenumber AS STRING)) END "
        "AS review_comment_title",
        ("CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE concat('qty ', CAST(CAST(l_quantity AS INT) AS STRING), "
         f"', flag \"', l_returnflag, '\"', {nl}, 'status ', l_linestatus) END AS review_comment_message"),
        "CASE WHEN l_suppkey % 37 = 0 THEN NULL ELSE l_shipdate END AS review_creation_date",
        "CASE WHEN l_suppkey % 37 = 0 THEN NULL ELSE l_shipdate END AS review_answer_timestamp",
    ]


def products_exprs(dialect: str) -> list[str]:
    return [
        "p_partkey AS product_id",
        "CASE WHEN p_size % 50 = 0 THEN NULL ELSE split_part(p_type, ' ', 1) END AS product_category_name",
        "CAST(length(p_name) AS INT) AS product_name_length",
        "p_size AS product_photos_qty",
    ]


def payments_exprs(dialect: str) -> list[str]:
    return [
        "o_orderkey AS order_id",
        "CAST(1 AS INT) AS payment_sequential",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'voucher' ELSE 'card' END AS payment_type",
        "CAST(1 + o_orderkey % 10 AS INT) AS payment_installments",
        "CAST(o_totalprice AS DECIMAL(10,2)) AS payment_value",
    ]


#: Driver table with as many rows as the model table has to have after its load.
SOURCE_OF = {"orders": "orders", "customers": "orders", "order_items": "lineitem", "order_payments": "orders",
             "order_reviews": "lineitem", "products": "part", "sellers": "supplier"}

# The category dictionary of the binding (PROMO deliberately absent).
CATEGORY_TRANSLATION_ROWS = [
    ("STANDARD", "standard goods"),
    ("ECONOMY", "economy goods"),
    ("MEDIUM", "medium goods"),
    ("SMALL", "small goods"),
    ("LARGE", "large goods"),
]


def _items_skew_safe(lineitem: DataFrame) -> DataFrame:
    """order_items with the item number computed without a single task per hot order.

    Same rows as ``items_exprs`` (the oracle's ``row_number() OVER (PARTITION BY
    l_orderkey ...)``): ``ranking.number_in_group`` numbers ordinary orders by
    that window and spreads an order holding a third of all lines over many
    tasks through a range-partitioned rank.
    """
    from churnlens.operators.ranking import number_in_group

    keys = [k.strip() for k in ITEMS_ORDER.split(",")]
    li = lineitem.select("l_orderkey", *keys)
    numbered = number_in_group(li, "l_orderkey", [F.col(k) for k in keys], "_item_no")
    exprs = [e for e in items_exprs("spark") if "order_item_id" not in e]
    return (numbered.withColumn("order_item_id", F.col("_item_no").cast("int"))
            .selectExpr(exprs[0], "order_item_id", *exprs[1:]))


def _values_sql() -> str:
    rows = ", ".join(f"('{a}', '{b}')" for a, b in CATEGORY_TRANSLATION_ROWS)
    return (f"SELECT * FROM (VALUES {rows}) "
            f"AS t(product_category_name, product_category_name_english)")


def oracle_views_sql() -> str:
    """The binding as DuckDB CTEs over the driver's pre-registered views."""
    d = "duckdb"
    return (
        "fx_orders AS (SELECT " + ", ".join(orders_exprs(d)) + " FROM orders),\n"
        "fx_customers AS (SELECT o.o_orderkey AS customer_id, o.o_custkey AS customer_unique_id, "
        "CAST(NULL AS VARCHAR) AS customer_zip_code_prefix, CAST(NULL AS VARCHAR) AS customer_city, "
        "n.n_name AS customer_state FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey "
        f"JOIN nation n ON n.n_nationkey = {STATE_NATION_KEY}),\n"
        "fx_order_items AS (SELECT " + ", ".join(items_exprs(d)) + " FROM lineitem),\n"
        "fx_order_reviews AS (SELECT " + ", ".join(reviews_exprs(d)) + " FROM lineitem),\n"
        "fx_products AS (SELECT " + ", ".join(products_exprs(d)) + " FROM part),\n"
        "fx_order_payments AS (SELECT " + ", ".join(payments_exprs(d)) + " FROM orders),\n"
        "fx_sellers AS (SELECT s.s_suppkey AS seller_id, n.n_name AS seller_state "
        "FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey),\n"
        "fx_category_translation AS (" + _values_sql() + ")"
    )


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixtures(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """How each table of the order model is derived from the driver tables in ``sf_dir``, by name."""
    rd = lambda n: read_driver_table(spark, sf_dir, n)
    d = "spark"

    def customers() -> DataFrame:
        o = rd("orders").select("o_orderkey", "o_custkey").alias("o")
        c = rd("customer").select("c_custkey", "c_nationkey").alias("c")
        n = rd("nation").select("n_nationkey", "n_name").alias("n")
        return (
            o.join(c, F.col("c.c_custkey") == F.col("o.o_custkey"))
            .join(n, F.col("n.n_nationkey") == F.expr(STATE_NATION_KEY))
            .select(F.col("o.o_orderkey").alias("customer_id"),
                    F.col("o.o_custkey").alias("customer_unique_id"),
                    F.lit(None).cast("string").alias("customer_zip_code_prefix"),
                    F.lit(None).cast("string").alias("customer_city"),
                    F.col("n.n_name").alias("customer_state")))

    def sellers() -> DataFrame:
        s = rd("supplier").select("s_suppkey", "s_nationkey")
        n = rd("nation").select("n_nationkey", "n_name")
        return s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(
            F.col("s_suppkey").alias("seller_id"), F.lit(None).cast("string").alias("seller_zip_code_prefix"),
            F.lit(None).cast("string").alias("seller_city"), F.col("n_name").alias("seller_state"))

    return {
        "orders": lambda: rd("orders").selectExpr(*orders_exprs(d)),
        "customers": customers,
        "order_items": lambda: _items_skew_safe(rd("lineitem")),
        "order_reviews": lambda: rd("lineitem").selectExpr(*reviews_exprs(d)),
        "products": lambda: rd("part").selectExpr(*products_exprs(d)),
        "category_translation": lambda: spark.sql(_values_sql()),  # a local relation: no Python worker, no scan
        "order_payments": lambda: rd("orders").selectExpr(*payments_exprs(d)),
        "sellers": sellers,
    }


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The order model derived (lazily) from the driver tables in ``sf_dir``."""
    return Tables(**{name: of() for name, of in fixtures(spark, sf_dir).items()})


#: Tables of which all joins go by the order id: stored bucketed by it.
FACTS = ("orders", "order_items", "order_reviews")


def store_by_order(df: DataFrame, name: str, path: str) -> list[DataFrame]:
    """A fact table's ordinary orders in a table bucketed by order id, and the hot ones - with more rows than an average
    bucket - in splittable files beside it, if there are any."""
    from churnlens.operators.ranking import split_hot_groups

    cold, hot = split_hot_groups(df, "order_id")
    parts = [sinks.write_bucketed(cold, name, "order_id")]
    if hot is not None:
        sinks.write_table(hot, path)
        parts.append(df.sparkSession.read.schema(df.schema).parquet(path))
    return parts


_LOADED: dict[tuple, Tables] = scratch_cache()
_LOAD_LOCK = threading.Lock()


def fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """Files, times and sizes of the input folder, listed by its own (Hadoop) file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (fs.makeQualified(path).toString(),
            *sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in fs.listStatus(path)))


def model_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The load step: bind the driver tables once and store the model as Parquet.

    Like the reference's load-once-then-query workflow, a bound table is
    written once per Spark application and input folder to the session's
    checkpoint folder (shared storage on a cluster), when a query first asks for it; every query then scans
    it with column pruning instead of re-deriving the binding. Facts are bucketed by order id, so
    orders join what is known of each of them without a shuffle of either. The scan
    DataFrames are kept too, so later queries do not infer the Parquet schemas
    again (the analogue of looking up a catalog table).
    """
    key = (spark.sparkContext.applicationId, fingerprint(spark, sf_dir))

    def write(name: str) -> list[DataFrame]:
        df, path = derived[name](), scratch_path(spark, name)
        if name in FACTS:
            return store_by_order(df, name, path)
        sinks.write_table(df, path)
        return [spark.read.schema(df.schema).parquet(path)]

    with _LOAD_LOCK:
        loaded = _LOADED.get(key)
        if loaded is None:
            derived = fixtures(spark, sf_dir)
            loaded = _LOADED[key] = StoredTables(list(derived), write)
    return loaded


def events_funnel_sql(dialect: str) -> str:
    """Second funnel binding: user-days of the events table, first time of each event type."""
    day = "CAST(ts AS DATE)"
    firsts = ", ".join(
        f"min(CASE WHEN event_type = '{e}' THEN ts END) AS t_{e}"
        for e in EVENT_STAGES)
    return f"SELECT user_id, {day} AS day, {firsts} FROM events GROUP BY user_id, {day}"


# Funnel stages of the events binding, in funnel order.
EVENT_STAGES = ("view", "click", "signup", "purchase", "error")


def events_user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_driver_table(spark, sf_dir, "events")
    day = F.to_date("ts")
    aggs = [F.min(F.when(F.col("event_type") == e, F.col("ts"))).alias(f"t_{e}") for e in EVENT_STAGES]
    return ev.groupBy(F.col("user_id"), day.alias("day")).agg(*aggs)


__all__ = ["fixtures", "fixture_tables", "model_tables", "oracle_views_sql", "events_user_days", "events_funnel_sql",
           "read_driver_table"]
