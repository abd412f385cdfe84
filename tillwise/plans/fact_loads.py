"""Fact and bridge loads: the rows each load would append.

Known rows are removed first, by source ids the fact itself carries, so that an incremental load resolves dimension
keys for new rows only, and a later dimension version never makes an old line look new. Where one id names the row at its
source (order lines, history rows, orders), known ids are exact bitmaps: ``loaded`` takes those kept with the fact, and
without them they are made from its id column; either way no id of the fact is shuffled. With neither, all rows are new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.cleanse import blank_to_null
from tillwise.operators.facts import incremental_append, resolved
from tillwise.operators.id_bitmaps import id_bitmaps, not_in
from tillwise.operators.lookup import calendar_keys, lookup_key
from tillwise.schemas import PARTITION_COLUMN, WAREHOUSE
from tillwise.sources.readers import TableReader

CART_LINE_KEYS = ["cartid_bk", "productid_bk", "productattributeid_bk", "customerid_bk"]
#: The id that names a row of the fact at its source.
ROW_IDS = {"fact_order_line": "orderdetailid_bk", "fact_order_history": "orderhistoryid_bk", "fact_order": "orderid_bk"}
PRODUCT_KEYS = {"productid_bk": "productid_bk", "productattributeid_bk": "productattributeid_bk"}
REQUIRED = ["product_sk", "customer_sk"]


def _layout(fact: str, key: str) -> list[str]:
    """Columns of a fact without its surrogate key, which the writer adds, plus the partition column."""
    return [c for c in WAREHOUSE[fact].names if c != key] + [PARTITION_COLUMN]


def _new(rows: DataFrame, name: str, fact: DataFrame | None, loaded: DataFrame | None) -> DataFrame:
    column = ROW_IDS[name]
    if loaded is None and fact is None:
        return rows
    return not_in(rows, column, loaded if loaded is not None else id_bitmaps(fact, column))


def bridge_rows(stage: TableReader, dim_product: DataFrame, dim_attribute: DataFrame, bridge: DataFrame) -> DataFrame:
    """Product-attribute pairs not in the bridge yet; every product version keeps its attributes."""
    combinations = stage("sg_product_attribute_combination").select(
        F.col("id_product_attribute").alias("productattributeid_bk"), F.col("id_attribute").alias("attributeid_bk")
    )
    products = dim_product.select("productattributeid_bk", F.col("product_key").alias("product_sk"))
    attributes = dim_attribute.select("attributeid_bk", F.col("attribute_key").alias("attribute_sk"))
    pairs = combinations.join(products, "productattributeid_bk").join(attributes, "attributeid_bk")
    return incremental_append(pairs, bridge, ["product_sk", "attribute_sk"]).select(
        *WAREHOUSE["bridge_product_attribute"].names
    )


def cart_line_candidates(
    stage: TableReader, fact: DataFrame, dim_product: DataFrame, dim_customer: DataFrame
) -> DataFrame:
    """New cart lines with the keys found; ``product_sk`` or ``customer_sk`` may be missing."""
    carts = stage("sg_cart").select(
        F.col("id_cart").alias("cartid_bk"), F.col("id_customer").alias("customerid_bk"), "date_add"
    )
    carts = lookup_key(
        carts, dim_customer, {"customerid_bk": "customerid_bk"}, "customer_key", "customer_sk", hot_from=carts
    )
    lines = stage("sg_cart_product").select(
        F.col("id_cart").alias("cartid_bk"),
        F.col("id_product").alias("productid_bk"),
        F.col("id_product_attribute").alias("productattributeid_bk"),
        "quantity",
    )
    new = incremental_append(lines.join(carts, "cartid_bk"), fact, CART_LINE_KEYS)
    return lookup_key(new, dim_product, PRODUCT_KEYS, "product_key", "product_sk", hot_from=lines)


def cart_line_rows(
    stage: TableReader, fact: DataFrame, dim_product: DataFrame, dim_customer: DataFrame, dim_date: DataFrame,
    dim_time: DataFrame,
) -> DataFrame:
    lines = resolved(cart_line_candidates(stage, fact, dim_product, dim_customer), REQUIRED)
    return calendar_keys(lines, "date_add", dim_date, dim_time).select(*_layout("fact_cart_line", "cartline_key"))


def order_line_candidates(
    stage: TableReader, fact: DataFrame | None, dim_product: DataFrame, dim_customer: DataFrame, dim_address: DataFrame,
    loaded: DataFrame | None = None,
) -> DataFrame:
    """New order lines with the keys found. Customer and address are looked up per order, the product per line."""
    details = stage("sg_order_detail").select(
        F.col("id_order").alias("orderid_bk"),
        F.col("id_order_detail").alias("orderdetailid_bk"),
        F.col("product_id").alias("productid_bk"),
        F.col("product_attribute_id").alias("productattributeid_bk"),
        F.col("product_quantity").alias("quantity"),
        F.col("unit_price_tax_excl").alias("price"),
        F.col("unit_price_tax_incl").alias("price_tax_incl"),
        F.col("total_price_tax_excl").alias("amount"),
        F.col("total_price_tax_incl").alias("amount_tax_incl"),
        F.col("tax_rate").alias("taxrate"),
    )
    new = _new(details, "fact_order_line", fact, loaded)
    all_orders = stage("sg_orders").select(
        F.col("id_order").alias("orderid_bk"),
        F.col("id_cart").alias("cartid_bk"),
        F.col("id_customer").alias("customerid_bk"),
        F.col("id_address_delivery").alias("addressid_bk"),
        "date_add",
        F.col("total_paid_tax_excl").alias("paid"),
        F.col("total_paid_tax_incl").alias("paid_tax_incl"),
        "conversion_rate",
        blank_to_null("carrier").alias("carrier"),
        F.col("payment").alias("paymenttype"),
    )
    orders = all_orders.join(new.select("orderid_bk").distinct(), "orderid_bk", "left_semi")
    orders = lookup_key(
        orders, dim_customer, {"customerid_bk": "customerid_bk"}, "customer_key", "customer_sk", hot_from=all_orders
    )
    orders = lookup_key(
        orders, dim_address, {"addressid_bk": "addressid_bk"}, "address_key", "address_sk", current_only=False,
        hot_from=all_orders,
    )
    lines = new.join(orders, "orderid_bk")
    return lookup_key(lines, dim_product, PRODUCT_KEYS, "product_key", "product_sk", hot_from=details)


def order_line_rows(
    stage: TableReader, fact: DataFrame | None, dim_product: DataFrame, dim_customer: DataFrame, dim_address: DataFrame,
    dim_date: DataFrame, dim_time: DataFrame, loaded: DataFrame | None = None,
) -> DataFrame:
    lines = resolved(order_line_candidates(stage, fact, dim_product, dim_customer, dim_address, loaded), REQUIRED)
    return calendar_keys(lines, "date_add", dim_date, dim_time).select(*_layout("fact_order_line", "orderline_key"))


def order_history_rows(
    stage: TableReader, fact: DataFrame | None, dim_order_state: DataFrame, dim_date: DataFrame, dim_time: DataFrame,
    loaded: DataFrame | None = None,
) -> DataFrame:
    """New history rows; an unknown state keeps a missing ``orderstate_sk``."""
    history = stage("sg_order_history").select(
        F.col("id_order_history").alias("orderhistoryid_bk"),
        F.col("id_order").alias("orderid_bk"),
        F.col("id_order_state").alias("orderstateid_bk"),
        "date_add",
    )
    new = _new(history, "fact_order_history", fact, loaded)
    new = lookup_key(
        new, dim_order_state, {"orderstateid_bk": "orderstateid_bk"}, "orderstate_key", "orderstate_sk",
        current_only=False, hot_from=history,
    )
    return calendar_keys(new, "date_add", dim_date, dim_time).select(
        *_layout("fact_order_history", "orderhistory_key")
    )


def order_rows(fact_order_line: DataFrame, fact_order: DataFrame | None, loaded: DataFrame | None = None) -> DataFrame:
    """One row per order, customer, address, day and hour for orders not in ``fact_order`` yet.

    Lines are aggregated (combined map-side) before known orders go, so the join moves orders instead of lines.
    """
    keys = ["orderid_bk", "customer_sk", "address_sk", "date_sk", "time_sk"]
    if PARTITION_COLUMN in fact_order_line.columns:
        keys.append(PARTITION_COLUMN)
    largest = ["paid", "paid_tax_incl", "taxrate", "conversion_rate", "paymenttype", "carrier"]
    orders = fact_order_line.groupBy(*keys).agg(*[F.max(c).alias(c) for c in largest])
    return _new(orders, "fact_order", fact_order, loaded).select(*keys, *largest)
