"""Shared order-model derivations on hand-made frames (m_status, m_cat)."""

from churnlens.operators.model import translated_categories, valid_status


def test_valid_status_drops_excluded_and_null_status(spark):
    df = spark.createDataFrame([("o1", "delivered"), ("o2", "canceled"), ("o3", "unavailable"), ("o4", None),
                                ("o5", "shipped")], "order_id string, order_status string")
    kept = sorted(r.order_id for r in df.filter(valid_status()).collect())
    assert kept == ["o1", "o5"]  # NOT IN is unknown for a NULL status, as in SQL


def test_translated_categories_fallbacks(spark):
    products = spark.createDataFrame([("p1", "cama_mesa"), ("p2", "pc_gamer"), ("p3", None)],
                                     "product_id string, product_category_name string")
    translation = spark.createDataFrame([("cama_mesa", "bed_table"), ("beleza", "beauty")],
                                        "product_category_name string, product_category_name_english string")
    got = {r.product_id: r.category for r in translated_categories(products, translation).collect()}
    assert got == {"p1": "bed_table", "p2": "pc_gamer", "p3": "unknown"}


def test_register_views_allows_sql_over_the_model(spark):
    from churnlens.sources.model import Tables
    one = spark.createDataFrame([("o1", "c1", "delivered")], "order_id string, customer_id string, order_status string")
    cust = spark.createDataFrame([("c1", "p1")], "customer_id string, customer_unique_id string")
    empty = spark.createDataFrame([], "x string")
    t = Tables(orders=one, customers=cust, order_items=empty, order_reviews=empty, products=empty,
               category_translation=empty)
    assert t.register_views("m_") == ["m_orders", "m_customers", "m_order_items", "m_order_reviews",
                                      "m_products", "m_category_translation"]
    r = spark.sql("SELECT c.customer_unique_id AS person, count(*) AS n FROM m_orders o "
                  "JOIN m_customers c USING (customer_id) GROUP BY 1").collect()
    assert [(x.person, x.n) for x in r] == [("p1", 1)]
