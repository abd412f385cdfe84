"""Menus: periods with data and product values to choose from."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.plans.periods import Period
from tillwise.plans.warehouse import Warehouse

# Menu entries without a product value of their own, and the columns a product can be chosen by.
ANY = "[Any]"
NOT_SPECIFIED = "[Not specified]"
CHOICES = ("market_group", "market_subgroup", "market_gender")


def min_date(dw: Warehouse) -> DataFrame:
    """Earliest day of a cart or order line, as one row. Facts shrink to their distinct days first."""
    days = dw.dim_date.select(F.col("date_key").alias("date_sk"), "date")

    def earliest(fact: DataFrame) -> DataFrame:
        return fact.select("date_sk").distinct().join(F.broadcast(days), "date_sk").agg(F.min("date").alias("date"))

    return earliest(dw.fact_cart_line).unionByName(earliest(dw.fact_order_line)).agg(F.min("date").alias("min_date"))


def _menu(dw: Warehouse, as_of: dt.date, *columns: str) -> DataFrame:
    days = dw.dim_date.crossJoin(F.broadcast(min_date(dw)))
    return days.filter(F.col("date").between(F.col("min_date"), F.lit(as_of))).select(*columns).distinct()


def months(dw: Warehouse, as_of: dt.date) -> DataFrame:
    return _menu(dw, as_of, "month_name", "year", "month").orderBy(F.desc("year"), "month")


def quarters(dw: Warehouse, as_of: dt.date) -> DataFrame:
    return _menu(dw, as_of, "quarter", "year").orderBy(F.desc("year"), "quarter")


def years(dw: Warehouse, as_of: dt.date) -> DataFrame:
    return _menu(dw, as_of, "year").orderBy(F.desc("year"))


def product_values(dw: Warehouse, column: str, period: Period) -> DataFrame:
    """Values of a product column among products valid in the period, after the entry for "any"."""
    if column not in CHOICES:
        raise ValueError(f"no menu for {column!r}")
    value = F.coalesce(F.col(column), F.lit(NOT_SPECIFIED)).alias(column)
    values = dw.dim_product.filter(period.overlaps()).select(value).distinct()
    any_entry = dw.dim_product.sparkSession.range(1).select(F.lit(ANY).alias(column))
    return any_entry.unionByName(values)


def chosen(choices: dict[str, str]) -> Column:
    """Predicate of the chosen menu entries, combined with AND; true when nothing is chosen."""
    unknown = set(choices) - set(CHOICES)
    if unknown:
        raise ValueError(f"unknown choices: {sorted(unknown)}")
    parts = []
    for column, value in choices.items():
        if value == NOT_SPECIFIED:
            parts.append(F.col(column).isNull())
        elif value != ANY:
            parts.append(F.col(column) == F.lit(value))
    return reduce(and_, parts, F.lit(True))
