"""Dashboard and report queries over the star schema.

Every query takes a ``Warehouse`` and a ``Period`` and returns a DataFrame.

Orders meet their payments through ``paid_marks``: the number of "paid" history rows per order and day. Counting them
before the join keeps the documented behaviour (an order marked paid twice counts twice) without ever building all
pairs of history rows and lines of one order. Grouping by order *and* day leaves a plain shuffle under both sides of
the join, which is what AQE needs to split an order that holds a large share of the lines.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.cleanse import GENDER_LABELS, NOT_STATED, labelled, number_or_zero
from tillwise.functions.dates import DAY_PART_ORDER, WEEKDAYS, age_decade, day_part, position_in
from tillwise.operators.median import exact_median
from tillwise.operators.trend import linear_trend
from tillwise.plans.menus import chosen
from tillwise.plans.periods import Period
from tillwise.plans.warehouse import Warehouse
from tillwise.schemas import PAID_STATE

TOP_MANUFACTURERS = 10


def paid_marks(dw: Warehouse, period: Period | None = None, label: Column | None = None) -> DataFrame:
    """(orderid_bk, paid_day, marks[, period]): paid history rows per order and day, optionally of days in a period."""
    history = dw.fact_order_history.filter(F.col("orderstateid_bk") == PAID_STATE)
    if period:
        history = dw.within(history, period, "date")
    keys = [F.col("orderid_bk"), F.col("date_sk").alias("paid_day")]
    if label is not None:
        keys.append(label.alias("period"))
    return history.groupBy(*keys).agg(F.count(F.lit(1)).alias("marks"))


def _times(value: str, marks: Column) -> Column:
    return F.col(value) * marks.cast("decimal(18,0)")


def carts_count(dw: Warehouse, period: Period) -> DataFrame:
    """Distinct carts with a line in the period."""
    return dw.within(dw.fact_cart_line, period).agg(F.count_distinct("cartid_bk").alias("carts_count"))


def orders_count(dw: Warehouse, period: Period) -> DataFrame:
    return dw.within(dw.fact_order, period).agg(F.count("orderid_bk").alias("orders_count"))


def orders_paid(dw: Warehouse, period: Period) -> DataFrame:
    """Paid orders and their revenue; the period is that of the order, and each paid mark counts."""
    orders = dw.within(dw.fact_order, period).select("orderid_bk", "paid_tax_incl")
    return orders.join(paid_marks(dw), "orderid_bk").agg(
        F.coalesce(F.sum("marks"), F.lit(0)).alias("orders_paid_count"),
        F.sum(_times("paid_tax_incl", F.col("marks"))).alias("total_revenue"),
    )


def summary(dw: Warehouse, period: Period) -> DataFrame:
    """The six key figures of a period, as one row."""
    return key_figures(orders_count(dw, period), orders_paid(dw, period), carts_count(dw, period))


def key_figures(orders: DataFrame, paid: DataFrame, carts: DataFrame) -> DataFrame:
    """Three one-row counts side by side. Only ``conversion_rate`` is rounded of the two rates."""
    figures = orders.crossJoin(F.broadcast(paid)).crossJoin(F.broadcast(carts))

    def per_cart(count: str) -> Column:
        carts = F.col("carts_count")
        return F.when(carts > 0, F.col(count) * F.lit(100.0) / carts).otherwise(F.lit(0.0))

    return figures.select(
        "orders_count",
        F.bround(number_or_zero(F.bround("total_revenue", 2)), 2).alias("total_revenue"),
        "orders_paid_count",
        "carts_count",
        F.bround(per_cart("orders_count"), 2).alias("conversion_rate"),
        per_cart("orders_paid_count").alias("conversion_rate_paid"),
    )


def period_revenue(dw: Warehouse, period: Period) -> DataFrame:
    """Revenue per period label; the period is that of the payment."""
    marks = paid_marks(dw, period, period.label(F.col("date")))
    return (
        marks.join(dw.fact_order.select("orderid_bk", "paid_tax_incl"), "orderid_bk")
        .groupBy("period")
        .agg(F.sum(_times("paid_tax_incl", F.col("marks"))).alias("total_revenue"))
        .orderBy("period")
    )


def period_revenue_trend(dw: Warehouse, period: Period) -> DataFrame:
    """Revenue per period label, rounded to whole units, with its linear trend."""
    rounded = period_revenue(dw, period).withColumn("total_revenue", F.bround("total_revenue", 0))
    return linear_trend(rounded, "period", "total_revenue").orderBy("period")


def orders_heatmap(dw: Warehouse, period: Period) -> DataFrame:
    """Median of the daily order counts per day part and weekday; days without an order do not count."""
    counts = (
        dw.within(dw.fact_order.select("date_sk", "time_sk", *_physical(dw.fact_order)), period)
        .groupBy("date_sk", "time_sk")
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    return heatmap_of(dw, counts)


def heatmap_of(dw: Warehouse, counts: DataFrame) -> DataFrame:
    """The heatmap of order counts per day and hour; everything here is bounded by the calendar."""
    days = F.broadcast(dw.dim_date.select(F.col("date_key").alias("date_sk"), "date", "day_name"))
    hours = F.broadcast(dw.dim_time.select(F.col("time_key").alias("time_sk"), "hour"))
    daily = (
        counts.join(days, "date_sk")
        .join(hours, "time_sk")
        .groupBy("date", day_part(F.col("hour")).alias("time_of_day"), "day_name")
        .agg(F.sum("orders").alias("orders"))
    )
    return (
        daily.groupBy("time_of_day", F.col("day_name").alias("day_of_week"))
        .agg(F.percentile("orders", F.lit(0.5)).alias("order_count"))
        .orderBy(
            position_in(F.col("time_of_day"), DAY_PART_ORDER), position_in(F.col("day_of_week"), WEEKDAYS)
        )
    )


def heatmap_matrix(dw: Warehouse, period: Period) -> DataFrame:
    """The heatmap as 4 day parts by 7 weekdays."""
    return matrix_of(orders_heatmap(dw, period))


def matrix_of(cells: DataFrame) -> DataFrame:
    """Heatmap cells as a matrix.

    An empty cell is 0 where its day part and its weekday occur at all; a day part or weekday without any order
    is NULL throughout.
    """
    seen = cells.agg(
        *[F.bool_or(F.col("day_of_week") == d).alias(f"_{d}") for d in WEEKDAYS],
    ).select("*", F.explode(F.array(*[F.lit(p) for p in DAY_PART_ORDER])).alias("time_of_day"))
    pivot = (
        cells.groupBy("time_of_day")
        .pivot("day_of_week", list(WEEKDAYS))
        .agg(F.first("order_count"))
        .withColumn("_row", F.lit(True))
    )
    return (
        seen.join(pivot, "time_of_day", "left")
        .orderBy(position_in(F.col("time_of_day"), DAY_PART_ORDER))
        .select(
            "time_of_day",
            *[F.when(F.col("_row") & F.col(f"_{d}"), F.coalesce(F.col(d), F.lit(0.0))).alias(d) for d in WEEKDAYS],
        )
    )


def carrier_revenue(dw: Warehouse, period: Period) -> DataFrame:
    """Revenue and number of paid orders per carrier, best first."""
    marks = F.col("marks")
    return (
        paid_marks(dw, period)
        .join(dw.fact_order.select("orderid_bk", "paid_tax_incl", "carrier"), "orderid_bk")
        .groupBy("carrier")
        .agg(F.sum(_times("paid_tax_incl", marks)).alias("total_revenue"), F.sum("marks").alias("total_count"))
        .orderBy(F.desc_nulls_first("total_revenue"), F.asc_nulls_last("carrier"))
        .withColumn("carrier", labelled(F.col("carrier")))
    )


def _revenue_by_product(dw: Warehouse, period: Period, attribute: str) -> DataFrame:
    """Line revenue paid in the period per product attribute. Lines are summed per product before meeting dim_product."""
    lines = dw.fact_order_line.select("orderid_bk", "product_sk", "amount_tax_incl")
    per_product = (
        paid_marks(dw, period)
        .join(lines, "orderid_bk")
        .groupBy("product_sk")
        .agg(F.sum(_times("amount_tax_incl", F.col("marks"))).alias("revenue"))
    )
    return revenue_by_attribute(dw, per_product, attribute)


def revenue_by_attribute(dw: Warehouse, per_product: DataFrame, attribute: str) -> DataFrame:
    products = dw.dim_product.select(F.col("product_key").alias("product_sk"), attribute)
    return (
        per_product.join(products, "product_sk")
        .groupBy(attribute)
        .agg(F.sum("revenue").cast("decimal(38,6)").alias("total_revenue"))
    )


def best_first(groups: DataFrame, attribute: str) -> DataFrame:
    return groups.orderBy(F.desc_nulls_first("total_revenue"), F.asc_nulls_last(attribute))


def top_manufacturers(dw: Warehouse, period: Period, count: int = TOP_MANUFACTURERS) -> DataFrame:
    return best_first(_revenue_by_product(dw, period, "manufacturer"), "manufacturer").limit(count)


def market_group_revenue(dw: Warehouse, period: Period) -> DataFrame:
    return best_first(_revenue_by_product(dw, period, "market_group"), "market_group")


def market_group_share(dw: Warehouse, period: Period) -> DataFrame:
    return share_of(_revenue_by_product(dw, period, "market_group"), "market_group")


def share_of(groups: DataFrame, attribute: str) -> DataFrame:
    """Revenue per group in whole units and its share of all groups."""
    groups = groups.select(attribute, F.bround("total_revenue", 0).alias("total_revenue"))
    whole = groups.agg(F.sum("total_revenue").alias("_whole"))
    share = F.when(F.col("_whole") != 0, F.col("total_revenue").cast("double") / F.col("_whole").cast("double"))
    shares = groups.crossJoin(F.broadcast(whole)).select(attribute, "total_revenue", share.alias("share"))  # one row
    return best_first(shares, attribute)


def gender_distribution(dw: Warehouse, period: Period, labels: dict[str, str] | None = None) -> DataFrame:
    """Active customer versions valid in the period, per gender."""
    return (
        dw.dim_customer.filter(F.col("active") & period.overlaps())
        .groupBy("gender")
        .agg(F.count("customer_key").alias("customers_count"))
        .withColumn("gender", labelled(F.col("gender"), labels))
    )


def gender_distribution_dashboard(dw: Warehouse, period: Period) -> DataFrame:
    return gender_distribution(dw, period, GENDER_LABELS)


def age_distribution(dw: Warehouse, period: Period, as_of: dt.date) -> DataFrame:
    """Average order value per age decade at ``as_of``. Orders are summed per customer before meeting dim_customer."""
    per_customer = (
        dw.within(dw.fact_order, period)
        .groupBy(F.col("customer_sk").alias("customer_key"))
        .agg(F.sum("paid_tax_incl").alias("paid"), F.count("paid_tax_incl").alias("orders"))
    )
    customers = dw.dim_customer.filter(period.overlaps()).select("customer_key", "birthdate")
    decade = age_decade(F.col("birthdate"), F.lit(as_of))
    per_decade = (
        per_customer.join(customers, "customer_key")
        .groupBy(decade.alias("age_range"))
        .agg(F.sum("paid").alias("paid"), F.sum("orders").alias("orders"))
    )
    value = F.when(F.col("orders") > 0, F.col("paid") / F.col("orders"))
    return per_decade.orderBy(F.asc_nulls_last("age_range")).select(
        labelled(F.col("age_range").cast("string")).alias("age_range"), F.bround(value, 2).alias("avg_order_value")
    )


def product_choice_revenue(dw: Warehouse, period: Period, choices: dict[str, str] | None = None) -> DataFrame:
    """Value of the paid orders per period label, for products of the chosen market group, subgroup or gender.

    The value of an order is counted once for each of its matching lines and each paid mark.
    """
    products = dw.dim_product.filter(period.overlaps() & chosen(choices or {})).select(
        F.col("product_key").alias("product_sk")
    )
    lines = (
        dw.within(dw.fact_order_line, period, "date")
        .select("orderid_bk", "product_sk", period.label(F.col("date")).alias("period"))
        .join(products, "product_sk")
        .groupBy("orderid_bk", "period")
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    per_order = dw.fact_order.select("orderid_bk", "paid_tax_incl").join(paid_marks(dw), "orderid_bk")
    return (
        lines.join(per_order, "orderid_bk")
        .groupBy("period")
        .agg(F.sum(_times("paid_tax_incl", F.col("marks") * F.col("lines"))).alias("total_revenue"))
        .orderBy("period")
        .withColumn("total_revenue", F.bround("total_revenue", 2))
    )


def customers_above_median(dw: Warehouse, period: Period) -> DataFrame:
    """What customers spent on paid orders above the median order value of the period, best first."""
    orders = dw.within(dw.fact_order, period).select("orderid_bk", "customer_sk", "paid_tax_incl")
    median = exact_median(orders, "paid_tax_incl", "median_order_total")
    above = orders.crossJoin(F.broadcast(median)).filter(F.col("paid_tax_incl") > F.col("median_order_total"))
    per_customer = (
        above.join(paid_marks(dw), "orderid_bk")
        .groupBy(F.col("customer_sk").alias("customer_key"))
        .agg(
            F.sum(_times("paid_tax_incl", F.col("marks"))).alias("spent"),
            F.sum("marks").alias("marks"),
        )
    )
    customers = dw.dim_customer.filter(period.overlaps()).select("customer_key", "customerid_bk")
    return (
        per_customer.join(customers, "customer_key")
        .groupBy(F.col("customerid_bk").alias("customer_id"))
        .agg(
            F.sum("spent").cast("decimal(38,6)").alias("total_spent"), F.sum("marks").alias("order_count")
        )
        .orderBy(F.desc_nulls_first("total_spent"), F.asc("customer_id"))
    )


def _physical(fact: DataFrame) -> list[str]:
    return [c for c in ("date_month",) if c in fact.columns]


