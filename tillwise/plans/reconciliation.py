"""What the facts should hold, from stage, and what they hold, with every surrogate key turned back into what it stands for.

Both sides have the same columns: source ids, measures, and for the surrogates the business keys of product, variant,
customer, address and order state, the day and the hour. A key that a load leaves empty because stage names an address,
state or moment the warehouse doesn't know is expected to be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.cleanse import blank_to_null
from tillwise.operators.checksums import reconcile_ranges
from tillwise.plans.warehouse import Warehouse
from tillwise.sources.readers import TableReader

#: Surrogate column -> (dimension, its key, {name on both sides: column of the dimension}).
SURROGATES = {
    "product_sk": ("dim_product", "product_key", {"productid_bk": "productid_bk", "productattributeid_bk": "productattributeid_bk"}),
    "customer_sk": ("dim_customer", "customer_key", {"customerid_bk": "customerid_bk"}),
    "address_sk": ("dim_address", "address_key", {"addressid_bk": "addressid_bk"}),
    "orderstate_sk": ("dim_order_state", "orderstate_key", {"stateid": "orderstateid_bk"}),
    "date_sk": ("dim_date", "date_key", {"day": "date"}),
    "time_sk": ("dim_time", "time_key", {"hour": "hour"}),
}
_CALENDAR = ("dim_date", "dim_time")
MEASURES = ["paid", "paid_tax_incl", "taxrate", "conversion_rate", "carrier", "paymenttype"]
FIELDS = {
    "fact_cart_line": (["cartid_bk", "productid_bk", "productattributeid_bk", "customerid_bk"], ["quantity", "day", "hour"]),
    "fact_order_line": (
        ["orderid_bk", "orderdetailid_bk"],
        ["cartid_bk", "productid_bk", "productattributeid_bk", "customerid_bk", "addressid_bk", "day", "hour", "quantity", "price", "price_tax_incl",
         "amount", "amount_tax_incl", *MEASURES],
    ),
    "fact_order_history": (["orderhistoryid_bk"], ["orderid_bk", "orderstateid_bk", "stateid", "day", "hour"]),
    "fact_order": (["orderid_bk"], ["customerid_bk", "addressid_bk", "day", "hour", *MEASURES]),
}


def with_meanings(dw: Warehouse, fact: DataFrame) -> DataFrame:
    """A fact with the meaning of each surrogate it has in place of the surrogate. Ids the fact keeps itself give way."""
    for column, (dimension, key, names) in SURROGATES.items():
        if column not in fact.columns:
            continue
        dim = getattr(dw, dimension).select(F.col(key).alias(column), *[F.col(there).alias(here) for here, there in names.items()])
        # The calendars are bounded by the number of days and hours.
        dim = F.broadcast(dim) if dimension in _CALENDAR else dim
        fact = fact.drop(*names).join(dim, column, "left").drop(column)
    return fact


def _known(rows: DataFrame, column: str, dim: DataFrame, bk: str) -> DataFrame:
    """``column`` emptied where the dimension has no version of it."""
    ids = dim.select(F.col(bk).alias(column)).distinct().withColumn("_known", F.lit(True))
    return rows.join(ids, column, "left").withColumn(column, F.when(F.col("_known"), F.col(column))).drop("_known")


def _day_and_hour(rows: DataFrame, dw: Warehouse, moment: str = "date_add") -> DataFrame:
    at = F.col(moment).cast("timestamp")
    days = F.broadcast(dw.dim_date.select(F.col("date").alias("_day"), F.col("date").alias("day")))
    return rows.withColumn("_day", F.to_date(at)).join(days, "_day", "left").withColumn("hour", F.hour(at)).drop("_day", moment)


def expected_order_lines(stage: TableReader, dw: Warehouse) -> DataFrame:
    orders = stage("sg_orders").select(
        F.col("id_order").alias("orderid_bk"), F.col("id_cart").alias("cartid_bk"), F.col("id_customer").alias("customerid_bk"),
        F.col("id_address_delivery").alias("addressid_bk"), "date_add", F.col("total_paid_tax_excl").alias("paid"),
        F.col("total_paid_tax_incl").alias("paid_tax_incl"), "conversion_rate", blank_to_null("carrier").alias("carrier"),
        F.col("payment").alias("paymenttype"),
    )
    orders = _day_and_hour(_known(orders, "addressid_bk", dw.dim_address, "addressid_bk"), dw)
    lines = stage("sg_order_detail").select(
        F.col("id_order").alias("orderid_bk"), F.col("id_order_detail").alias("orderdetailid_bk"), F.col("product_id").alias("productid_bk"),
        F.col("product_attribute_id").alias("productattributeid_bk"), F.col("product_quantity").alias("quantity"),
        F.col("unit_price_tax_excl").alias("price"), F.col("unit_price_tax_incl").alias("price_tax_incl"),
        F.col("total_price_tax_excl").alias("amount"), F.col("total_price_tax_incl").alias("amount_tax_incl"), F.col("tax_rate").alias("taxrate"),
    )
    return lines.join(orders, "orderid_bk")


def expected_orders(lines: DataFrame) -> DataFrame:
    """Orders from their expected lines."""
    return lines.groupBy("orderid_bk", "customerid_bk", "addressid_bk", "day", "hour").agg(*[F.max(c).alias(c) for c in MEASURES])


def expected_cart_lines(stage: TableReader, dw: Warehouse) -> DataFrame:
    carts = stage("sg_cart").select(F.col("id_cart").alias("cartid_bk"), F.col("id_customer").alias("customerid_bk"), "date_add")
    lines = stage("sg_cart_product").select(
        F.col("id_cart").alias("cartid_bk"), F.col("id_product").alias("productid_bk"), F.col("id_product_attribute").alias("productattributeid_bk"), "quantity"
    )
    return lines.join(_day_and_hour(carts, dw), "cartid_bk")


def expected_history(stage: TableReader, dw: Warehouse) -> DataFrame:
    history = stage("sg_order_history").select(
        F.col("id_order_history").alias("orderhistoryid_bk"), F.col("id_order").alias("orderid_bk"), F.col("id_order_state").alias("orderstateid_bk"),
        F.col("id_order_state").alias("stateid"), "date_add",
    )
    return _day_and_hour(_known(history, "stateid", dw.dim_order_state, "orderstateid_bk"), dw)


def findings(name: str, expected: DataFrame, actual: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Mismatches of a fact, of some fields or all."""
    key, every = FIELDS[name]
    return reconcile_ranges(expected, actual, key, fields or every)
