"""The relational order model the analyses run on.

Column names follow the reference's schema (orders, customers, order_items,
order_reviews, products, category_translation); ``Tables`` bundles the frames.
Any source that produces these columns can feed every operator.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ORDERS_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("order_status", T.StringType()),
    T.StructField("order_purchase_timestamp", T.TimestampNTZType()),
    T.StructField("order_approved_at", T.TimestampNTZType()),
    T.StructField("order_delivered_carrier_date", T.TimestampNTZType()),
    T.StructField("order_delivered_customer_date", T.TimestampNTZType()),
    T.StructField("order_estimated_delivery_date", T.TimestampNTZType()),
])

CUSTOMERS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_unique_id", T.StringType()),
    T.StructField("customer_zip_code_prefix", T.StringType()),
    T.StructField("customer_city", T.StringType()),
    T.StructField("customer_state", T.StringType()),
])

ORDER_ITEMS_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("order_item_id", T.IntegerType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("seller_id", T.StringType()),
    T.StructField("shipping_limit_date", T.TimestampNTZType()),
    T.StructField("price", T.DecimalType(10, 2)),
    T.StructField("freight_value", T.DecimalType(10, 2)),
])

ORDER_PAYMENTS_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("payment_sequential", T.IntegerType()),
    T.StructField("payment_type", T.StringType()),
    T.StructField("payment_installments", T.IntegerType()),
    T.StructField("payment_value", T.DecimalType(10, 2)),
])

ORDER_REVIEWS_SCHEMA = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("review_score", T.ByteType()),
    T.StructField("review_comment_title", T.StringType()),
    T.StructField("review_comment_message", T.StringType()),
    T.StructField("review_creation_date", T.TimestampNTZType()),
    T.StructField("review_answer_timestamp", T.TimestampNTZType()),
])

PRODUCTS_SCHEMA = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("product_category_name", T.StringType()),
    T.StructField("product_name_length", T.IntegerType()),
    T.StructField("product_description_length", T.IntegerType()),
    T.StructField("product_photos_qty", T.IntegerType()),
    T.StructField("product_weight_g", T.IntegerType()),
    T.StructField("product_length_cm", T.IntegerType()),
    T.StructField("product_height_cm", T.IntegerType()),
    T.StructField("product_width_cm", T.IntegerType()),
])

SELLERS_SCHEMA = T.StructType([
    T.StructField("seller_id", T.StringType()),
    T.StructField("seller_zip_code_prefix", T.StringType()),
    T.StructField("seller_city", T.StringType()),
    T.StructField("seller_state", T.StringType()),
])

CATEGORY_TRANSLATION_SCHEMA = T.StructType([
    T.StructField("product_category_name", T.StringType()),
    T.StructField("product_category_name_english", T.StringType()),
])

GEOLOCATION_SCHEMA = T.StructType([
    T.StructField("geolocation_zip_code_prefix", T.StringType()),
    T.StructField("geolocation_lat", T.DecimalType(11, 8)),
    T.StructField("geolocation_lng", T.DecimalType(11, 8)),
    T.StructField("geolocation_city", T.StringType()),
    T.StructField("geolocation_state", T.StringType()),
])

# Declared keys (order_reviews and geolocation have none, on purpose).
PRIMARY_KEYS = {
    "customers": ("customer_id",),
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"),
    "products": ("product_id",),
    "sellers": ("seller_id",),
    "category_translation": ("product_category_name",),
}

# Columns whose empty CSV field means NULL (the loader's NULLIF list).
EMPTY_AS_NULL = {
    "orders": ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date", "order_estimated_delivery_date"),
    "order_items": ("shipping_limit_date",),
    "order_reviews": ("review_comment_title", "review_comment_message",
                      "review_creation_date", "review_answer_timestamp"),
    "products": ("product_category_name", "product_name_length", "product_description_length",
                 "product_photos_qty", "product_weight_g", "product_length_cm",
                 "product_height_cm", "product_width_cm"),
}

SCHEMAS = {
    "customers": CUSTOMERS_SCHEMA,
    "orders": ORDERS_SCHEMA,
    "order_items": ORDER_ITEMS_SCHEMA,
    "order_payments": ORDER_PAYMENTS_SCHEMA,
    "order_reviews": ORDER_REVIEWS_SCHEMA,
    "products": PRODUCTS_SCHEMA,
    "sellers": SELLERS_SCHEMA,
    "category_translation": CATEGORY_TRANSLATION_SCHEMA,
    "geolocation": GEOLOCATION_SCHEMA,
}


@dataclass
class Tables:
    """The frames the operators read. Key columns may be strings or integers.

    ``parts`` may hold a table's rows again in parts with no order in common: the ordinary orders bucketed by order id, and the hot ones.
    """

    orders: DataFrame
    customers: DataFrame
    order_items: DataFrame
    order_reviews: DataFrame
    products: DataFrame
    category_translation: DataFrame
    order_payments: DataFrame | None = None
    sellers: DataFrame | None = None
    parts: dict[str, list[DataFrame]] = field(default_factory=dict)

    def by_order(self, name: str) -> list[DataFrame]:
        """A fact table's parts, or the table whole. What is computed within orders may be computed part by part."""
        return self.parts.get(name) or [getattr(self, name)]

    def as_dict(self) -> dict[str, DataFrame]:
        """The tables that there are, by name; no analysis needs payments or sellers, but both are loaded and checked."""
        names = ("orders", "customers", "order_items", "order_reviews", "products", "category_translation", "order_payments", "sellers")
        return {name: getattr(self, name) for name in names if getattr(self, name) is not None}

    def register_views(self, prefix: str = "") -> list[str]:
        """Register each table as a session temporary view (``prefix`` + table name),
        so the order model can also be queried with ``spark.sql``. Returns the names."""
        names = []
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names


class StoredTables(Tables):
    """Tables of which each is written when it is first asked for, so that a query loads only what it reads.

    ``write`` stores one of the tables ``names`` and returns it in parts, as ``Tables.parts`` has them.
    """

    def __init__(self, names: Iterable[str], write: Callable[[str], list[DataFrame]]):
        self._write, self._written, self._locks = write, {}, {name: threading.Lock() for name in names}

    def by_order(self, name: str) -> list[DataFrame]:
        with self._locks[name]:
            if name not in self._written:
                self._written[name] = self._write(name)
            return self._written[name]

    def as_dict(self) -> dict[str, DataFrame]:
        # independent writes: submitted together so the scheduler overlaps them
        with ThreadPoolExecutor(max_workers=len(self._locks)) as pool:
            list(pool.map(self.by_order, self._locks))
        return super().as_dict()

    def _whole(self, name: str) -> DataFrame | None:
        if name not in self._locks:
            return None
        parts = self.by_order(name)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    orders = property(lambda self: self._whole("orders"))
    customers = property(lambda self: self._whole("customers"))
    order_items = property(lambda self: self._whole("order_items"))
    order_reviews = property(lambda self: self._whole("order_reviews"))
    products = property(lambda self: self._whole("products"))
    category_translation = property(lambda self: self._whole("category_translation"))
    order_payments = property(lambda self: self._whole("order_payments"))
    sellers = property(lambda self: self._whole("sellers"))
