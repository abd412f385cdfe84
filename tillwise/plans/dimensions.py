"""Dimension loads: what each dimension takes from stage, and how it is merged."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.cleanse import blank_to_null, blank_to_unknown, stated_gender
from tillwise.operators.joins import attach
from tillwise.operators.scd import scd1_upsert, scd2_merge, scd2_step
from tillwise.sources.readers import TableReader


def address_rows(stage: TableReader) -> DataFrame:
    countries = stage("sg_country").select("id_country", F.col("name").alias("country"))
    states = stage("sg_state").select("id_state", F.col("name").alias("state"))
    return (
        stage("sg_address")
        .join(countries, "id_country", "left")
        .join(states, "id_state", "left")
        .select(
            F.col("id_address").alias("addressid_bk"),
            F.col("id_customer").alias("customerid_bk"),
            blank_to_null("country").alias("country"),
            blank_to_null("state").alias("state"),
            blank_to_null("city").alias("city"),
            F.col("postcode").alias("zipcode"),
            "date_add",
        )
    )


def customer_rows(stage: TableReader) -> DataFrame:
    """Customers with group, gender and business flag.

    A group gives its name only if it has at least one member, whoever that is. Groups and genders are shared by many
    customers, hence the skew-safe lookups; the business flag is looked up by the customer's own, unique id.
    """
    customers = stage("sg_customer")
    members = stage("sg_customer_group").select("id_group").distinct()
    groups = (
        stage("sg_group")
        .join(members, "id_group", "left_semi")
        .groupBy(F.col("id_group").alias("id_default_group"))
        .agg(F.max("name").alias("defaultgroup"))
    )
    genders = stage("sg_gender").groupBy("id_gender").agg(F.max("name").alias("gender"))
    companies = stage("sg_customer_company").select("id_customer").distinct().withColumn("is_company", F.lit(True))
    rows = attach(customers, groups, ["id_default_group"], customers)
    rows = attach(rows, genders, ["id_gender"], customers)
    return rows.join(companies, "id_customer", "left").select(
        F.col("id_customer").alias("customerid_bk"),
        F.col("hashed_login").alias("hashedemail"),
        "defaultgroup",
        F.col("birthday").alias("birthdate"),
        stated_gender("gender").alias("gender"),
        F.col("is_company").isNotNull().alias("businessaccount"),
        "active",
        "date_add",
    )


def product_rows(stage: TableReader) -> DataFrame:
    manufacturers = stage("sg_manufacturer").select("id_manufacturer", F.col("name").alias("manufacturer"))
    categories = stage("sg_category").select(
        F.col("id_category").alias("id_category_default"), F.col("name").alias("defaultcategory")
    )
    return (
        stage("sg_product")
        .join(manufacturers, "id_manufacturer", "left")
        .join(categories, "id_category_default", "left")
        .select(
            F.col("id_product").alias("productid_bk"),
            F.coalesce("id_product_attribute", F.lit(0)).cast("long").alias("productattributeid_bk"),
            F.col("name").alias("productname"),
            blank_to_null("manufacturer").alias("manufacturer"),
            blank_to_null("defaultcategory").alias("defaultcategory"),
            blank_to_null("group").alias("market_group"),
            blank_to_null("subgroup").alias("market_subgroup"),
            blank_to_null("gender").alias("market_gender"),
            "price",
            "active",
            "date_add",
        )
    )


def order_state_rows(stage: TableReader) -> DataFrame:
    return stage("sg_order_state").select(
        F.col("id_order_state").alias("orderstateid_bk"), F.col("name").alias("current_state")
    )


def attribute_rows(stage: TableReader) -> DataFrame:
    groups = stage("sg_attribute_group").select("id_attribute_group", F.col("name").alias("attribute_group"))
    return (
        stage("sg_attribute")
        .join(groups, "id_attribute_group", "left")
        .select(
            F.col("id_attribute").alias("attributeid_bk"),
            blank_to_unknown("name").alias("attribute_name"),
            blank_to_null("attribute_group").alias("attribute_group"),
        )
    )


@dataclass(frozen=True)
class Dimension:
    name: str
    key: str
    bk: list[str]
    tracked: list[str]
    rows: Callable[[TableReader], DataFrame]
    carried: list[str] = field(default_factory=list)
    since: str | None = "date_add"

    def step(self, stage: TableReader, current: DataFrame, as_of: dt.date) -> DataFrame:
        """Rows of the next run; see ``scd2_step``."""
        return scd2_step(
            self.rows(stage), current, self.bk, self.tracked, self.key, as_of, carried=self.carried, since=self.since
        )

    def merged(self, stage: TableReader, dim: DataFrame, as_of: dt.date) -> DataFrame:
        """The whole dimension after a load."""
        return scd2_merge(
            self.rows(stage), dim, self.bk, self.tracked, self.key, as_of, carried=self.carried, since=self.since
        )


ADDRESS = Dimension(
    "dim_address", "address_key", ["addressid_bk"], ["country", "state", "city", "zipcode"], address_rows,
    carried=["customerid_bk"],
)
CUSTOMER = Dimension(
    "dim_customer", "customer_key", ["customerid_bk"],
    ["hashedemail", "defaultgroup", "birthdate", "gender", "businessaccount", "active"], customer_rows,
)
PRODUCT = Dimension(
    "dim_product", "product_key", ["productid_bk", "productattributeid_bk"],
    ["productname", "manufacturer", "defaultcategory", "market_group", "market_subgroup", "market_gender", "price",
     "active"],
    product_rows,
)
ORDER_STATE = Dimension(
    "dim_order_state", "orderstate_key", ["orderstateid_bk"], ["current_state"], order_state_rows, since=None
)


def attributes_merged(stage: TableReader, dim: DataFrame) -> DataFrame:
    """The attribute dimension after a load; changed rows are overwritten in place."""
    return scd1_upsert(
        attribute_rows(stage), dim, ["attributeid_bk"], ["attribute_name", "attribute_group"], "attribute_key"
    )
