"""Extraction of the 25 shop tables into stage: one declarative spec per table.

A spec names the source, the target, the columns with their cleansing kind (``functions.cleanse.KINDS``) and, for the
joined tables, the function that builds the raw rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.cleanse import cleanse, stage_schema
from tillwise.operators.joins import dealt_left_join, fanout_left_join

if TYPE_CHECKING:
    from tillwise.sources.readers import TableReader


#: Rows that a task compares, about.
TASK_ROWS = 1 << 18


@dataclass(frozen=True)
class Extract:
    source: str
    target: str
    columns: dict[str, str]
    rows: Callable[[TableReader], DataFrame] | None = None

    def apply(self, read: TableReader) -> DataFrame:
        raw = self.rows(read) if self.rows else read(self.source)
        return cleanse(raw, self.columns)

    @property
    def schema(self) -> T.StructType:
        return stage_schema(self.columns)


def _columns(spec: str) -> dict[str, str]:
    return dict(item.split(":") for item in spec.split())


def _own(read: TableReader, target: str, brought: list[str], keys: list[str]) -> DataFrame:
    """The source's own part of a joined extraction: its join keys and the columns no other table brings."""
    own = [c for c in SPECS[target].columns if c not in brought]
    return read(SPECS[target].source).select(*[f"`{c}`" for c in dict.fromkeys([*keys, *own])])


def product_variants(read: TableReader) -> DataFrame:
    """One row per product variant; a product without variants keeps one row."""
    variants = read("ps_product_attribute").select("id_product", "id_product_attribute")
    return fanout_left_join(_own(read, "sg_product", ["id_product_attribute"], []), variants, ["id_product"])


def carts_with_carrier(read: TableReader) -> DataFrame:
    carriers = read("ps_carrier").select("id_carrier", F.col("name").alias("carrier"))
    return _distinct(_own(read, "sg_cart", ["carrier"], ["id_carrier"]).join(carriers, "id_carrier", "left"), "sg_cart")


def orders_with_carrier(read: TableReader) -> DataFrame:
    """An order shipped by two carriers yields two rows; only exact repeats are removed.

    Both sides are made distinct before the join, so the wide rows are never compared after the fan-out.
    """
    carriers = read("ps_carrier").select("id_carrier", F.col("name").alias("carrier"))
    shipped = read("ps_order_carrier").select("id_order", "id_carrier").join(carriers, "id_carrier", "left")
    sources = [read("ps_order_carrier"), read("ps_orders")]
    names = _distinct_by(shipped.select("id_order", "carrier"), "id_order", sources)
    orders = _distinct_by(_own(read, "sg_orders", ["carrier"], []), "id_order", sources)
    return fanout_left_join(orders, names, ["id_order"])


def order_lines_with_tax(read: TableReader) -> DataFrame:
    """A line taxed twice yields two rows; only exact repeats are removed, before the join as above."""
    taxes = read("ps_tax").select("id_tax", F.col("rate").alias("tax_rate"), F.col("name").alias("tax_name"))
    taxed = read("ps_order_detail_tax").select("id_order_detail", "id_tax").join(taxes, "id_tax", "left")
    sources = [read("ps_order_detail_tax"), read("ps_order_detail")]
    rates = _distinct_by(taxed.select("id_order_detail", "tax_rate", "tax_name"), "id_order_detail", sources)
    lines = _distinct_by(_own(read, "sg_order_detail", ["tax_rate", "tax_name"], []), "id_order_detail", sources)
    return fanout_left_join(lines, rates, ["id_order_detail"])


def payments_with_order(read: TableReader) -> DataFrame:
    """A payment yields a row per order of its reference; only exact repeats are removed.

    A row can repeat behind the join only if its payment comes under several references, so only those are compared
    there. All others are made distinct and cleansed before the fan-out, which may make far more rows than it reads.
    """
    target = "sg_order_payment"
    columns = {name: kind for name, kind in SPECS[target].columns.items() if name != "id_order"}
    reference, same = F.struct("order_reference"), Window.partitionBy(*[f"`{c}`" for c in columns])
    several = ~F.min(reference).over(same).eqNullSafe(F.max(reference).over(same))
    payments = _own(read, target, ["id_order"], ["order_reference"]).withColumn("_several", several).distinct()
    orders = read("ps_orders").select(F.col("reference").alias("order_reference"), "id_order").distinct()
    single = cleanse(payments.filter("NOT _several"), columns, keep=("order_reference",))
    references = read(SPECS[target].source).select("order_reference"), read("ps_orders").select(F.col("reference").alias("order_reference"))
    once = dealt_left_join(single, orders, ["order_reference"], references).select(*SPECS[target].columns)
    repeated = _distinct(fanout_left_join(payments.filter("_several"), orders, ["order_reference"]), target)
    return once.unionByName(cleanse(repeated, SPECS[target].columns))


def _distinct_by(df: DataFrame, key: str, sources: list[DataFrame]) -> DataFrame:
    """Distinct rows, compared where a join by ``key`` wants them: scans hold no rows, and the wide rows travel once.

    Where the rows of the largest of ``sources`` are many for the session's shuffle partitions, there are more of them, so that what a task
    holds doesn't grow with the table.
    """
    many = max(source.count() for source in sources) // TASK_ROWS
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartition(many, key) if many > usual else df.repartition(key)).distinct()


def _distinct(df: DataFrame, target: str) -> DataFrame:
    return df.select(*[f"`{name}`" for name in SPECS[target].columns]).distinct()


# Source tables, target tables and their columns.
_ALL = [
    Extract("ps_address", "sg_address", _columns(
        "id_address:id id_country:id id_state:id id_customer:id id_customer_company:id postcode:text city:text "
        "date_add:moment date_upd:moment active:flag deleted:flag default:flag has_phone:flag")),
    Extract("ps_country", "sg_country", _columns(
        "id_country:id id_zone:id iso_code:text call_prefix:int active:flag contains_states:flag "
        "need_zip_code:flag zip_code_format:text default_tax:int name:text")),
    Extract("ps_customer", "sg_customer", _columns(
        "id_customer:id id_gender:id id_default_group:id hashed_login:text birthday:day newsletter:flag "
        "active:flag is_guest:flag deleted:flag date_add:moment date_upd:moment")),
    Extract("ps_customer_company", "sg_customer_company", _columns(
        "id_customer_company:id id_customer:id name:hashed verified:flag active:flag date_add:moment "
        "date_upd:moment id_address:id")),
    Extract("ps_customer_group", "sg_customer_group", _columns("id_customer:id id_group:id")),
    Extract("ps_gender", "sg_gender", _columns("id_gender:id type:int name:text")),
    Extract("ps_group", "sg_group", _columns(
        "id_group:id date_add:moment date_upd:moment is_wholesale:flag order_days_return:int "
        "order_days_complaint:int name:text")),
    Extract("ps_category", "sg_category", _columns(
        "id_category:id id_parent:id level_depth:int nleft:int nright:int active:flag date_add:moment "
        "date_upd:moment is_root_category:flag name:text")),
    Extract("ps_manufacturer", "sg_manufacturer", _columns(
        "id_manufacturer:id name:text date_add:moment date_upd:moment active:flag")),
    Extract("ps_product_attribute_combination", "sg_product_attribute_combination", _columns(
        "id_attribute:id id_product_attribute:id")),
    Extract("ps_attribute", "sg_attribute", _columns("id_attribute:id id_attribute_group:id color:text name:text")),
    Extract("ps_attribute_group", "sg_attribute_group", _columns(
        "id_attribute_group:id is_color_group:flag name:text")),
    Extract("ps_currency", "sg_currency", _columns(
        "id_currency:id name:text iso_code:text iso_code_num:text sign:text blank:flag format:flag decimals:int "
        "conversion_rate:money default_vat_rate:money deleted:flag active:flag default_on_instance:int")),
    Extract("ps_cart_product", "sg_cart_product", _columns(
        "id_cart:id id_product:id id_product_attribute:id quantity:int date_add:moment")),
    Extract("ps_order_history", "sg_order_history", _columns(
        "id_order_history:id id_order:id id_order_state:id date_add:moment")),
    Extract("ps_order_state", "sg_order_state", _columns(
        "id_order_state:id invoice:flag slip:flag color:text unremovable:flag hidden:flag shipped:flag paid:flag "
        "closed:int is_canceled_state:flag can_send_repay:flag can_be_canceled:flag name:text")),
    Extract("ps_order_slip", "sg_order_slip", _columns(
        "id_order_slip:id conversion_rate:money id_customer:id id_order:id total_products_tax_excl:money "
        "total_products_tax_incl:money total_shipping_tax_excl:money total_shipping_tax_incl:money "
        "shipping_cost:money amount:money shipping_cost_amount:money partial:flag date_add:moment "
        "date_upd:moment")),
    Extract("ps_order_slip_detail", "sg_order_slip_detail", _columns(
        "id_order_slip:id id_order_detail:id product_quantity:int unit_price_tax_excl:money "
        "unit_price_tax_incl:money total_price_tax_excl:money total_price_tax_incl:money amount_tax_excl:money "
        "amount_tax_incl:money")),
    Extract("ps_product", "sg_product", _columns(
        "id_product:id id_product_attribute:id id_manufacturer:id id_category_default:id price:money "
        "wholesale_price:money active:flag available_for_order:flag date_add:moment date_upd:moment "
        "price_type:text force_disable:int only_for_loyalty:int has_loyalty_price:int is_rental:int "
        "rental_price:money name:text season:text group:text subgroup:text gender:text"), product_variants),
    Extract("ps_stock_available", "sg_stock_available", _columns(
        "id_stock_available:id id_product:id id_product_attribute:id quantity:int date_add:moment "
        "date_upd:moment")),
    Extract("ps_cart", "sg_cart", _columns(
        "id_cart:id carrier:text id_address_invoice:id id_currency:id id_customer:id free_shipping:int "
        "date_add:moment date_upd:moment"), carts_with_carrier),
    Extract("ps_orders", "sg_orders", _columns(
        "id_order:id id_customer:id id_cart:id id_currency:id carrier:text id_address_delivery:id "
        "current_state:id payment:text conversion_rate:money total_discounts:money "
        "total_discounts_tax_incl:money total_discounts_tax_excl:money total_paid:money "
        "total_paid_tax_incl:money total_paid_tax_excl:money total_paid_real:money total_products:money "
        "total_products_wt:money total_shipping:money total_shipping_tax_incl:money "
        "total_shipping_tax_excl:money carrier_tax_rate:money total_cod_tax_incl:money valid:int "
        "date_add:moment date_upd:moment split_number:int main_order_id:id ip:text review_mail_sent:flag"),
        orders_with_carrier),
    Extract("ps_order_detail", "sg_order_detail", _columns(
        "id_order_detail:id id_order:id product_id:id product_attribute_id:id product_name:text "
        "product_quantity:int product_quantity_in_stock:int product_price:money reduction_amount:money "
        "reduction_amount_tax_incl:money reduction_amount_tax_excl:money tax_computation_method:int "
        "total_price_tax_incl:money total_price_tax_excl:money unit_price_tax_incl:money "
        "unit_price_tax_excl:money purchase_supplier_price:money tax_rate:rate_or_0 tax_name:text"),
        order_lines_with_tax),
    Extract("ps_order_payment", "sg_order_payment", _columns(
        "id_order_payment:id id_order:id_or_0 id_currency:id amount:money payment_method:text date_add:moment"),
        payments_with_order),
    Extract("ps_state", "sg_state", _columns("id_state:id id_country:id name:text iso_code:text")),
]

SPECS: dict[str, Extract] = {spec.target: spec for spec in _ALL}
