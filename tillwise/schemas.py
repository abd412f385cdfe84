"""Warehouse table schemas (data model: star schema with validity intervals)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

MONEY = T.DecimalType(20, 6)
OPEN_END = dt.date(9999, 12, 31)
FIRST_DAY = dt.date(2000, 1, 1)
PAID_STATE = 2

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "text": T.StringType(),
    "money": MONEY,
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "moment": T.TimestampType(),
}


def schema(spec: str) -> T.StructType:
    """``"a:long b:text"`` to a StructType."""
    fields = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


# Table and column names of the warehouse model.
# fact_cart_line also keeps the source ids of the line; its load recognises known lines by them.
# date_month (yyyymm, 0 = unknown day) is the physical partition column of the facts.
WAREHOUSE = {
    "dim_date": schema(
        "date_key:long date:date year:int quarter:int month:int month_name:text day:int day_of_week:int "
        "day_name:text week_of_year:int is_weekend:bool"
    ),
    "dim_time": schema("time_key:long time:text hour:int"),
    "dim_address": schema(
        "address_key:long addressid_bk:long customerid_bk:long country:text state:text city:text zipcode:text "
        "valid_from:date valid_to:date"
    ),
    "dim_customer": schema(
        "customer_key:long customerid_bk:long hashedemail:text defaultgroup:text birthdate:date gender:text "
        "businessaccount:bool active:bool valid_from:date valid_to:date"
    ),
    "dim_product": schema(
        "product_key:long productid_bk:long productattributeid_bk:long productname:text manufacturer:text "
        "defaultcategory:text market_group:text market_subgroup:text market_gender:text price:money active:bool "
        "valid_from:date valid_to:date"
    ),
    "dim_order_state": schema(
        "orderstate_key:long orderstateid_bk:long current_state:text valid_from:date valid_to:date"
    ),
    "dim_attribute": schema("attribute_key:long attributeid_bk:long attribute_name:text attribute_group:text"),
    "bridge_product_attribute": schema(
        "product_sk:long attribute_sk:long productattributeid_bk:long attributeid_bk:long"
    ),
    "fact_cart_line": schema(
        "cartline_key:long cartid_bk:long product_sk:long customer_sk:long date_sk:long time_sk:long quantity:int "
        "productid_bk:long productattributeid_bk:long customerid_bk:long"
    ),
    "fact_order_line": schema(
        "orderline_key:long orderid_bk:long orderdetailid_bk:long cartid_bk:long product_sk:long customer_sk:long "
        "address_sk:long date_sk:long time_sk:long quantity:int price:money price_tax_incl:money amount:money "
        "amount_tax_incl:money paid:money paid_tax_incl:money taxrate:money conversion_rate:money carrier:text "
        "paymenttype:text"
    ),
    "fact_order_history": schema(
        "orderhistory_key:long orderhistoryid_bk:long orderstate_sk:long orderid_bk:long orderstateid_bk:long "
        "date_sk:long time_sk:long"
    ),
    "fact_order": schema(
        "order_key:long orderid_bk:long customer_sk:long address_sk:long date_sk:long time_sk:long paid:money "
        "paid_tax_incl:money taxrate:money conversion_rate:money paymenttype:text carrier:text"
    ),
}

PARTITION_COLUMN = "date_month"
PARTITIONED_FACTS = ("fact_cart_line", "fact_order_line", "fact_order_history", "fact_order")
