"""The star schema as lazy DataFrames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.operators.lookup import key_of_day
from tillwise.plans.periods import Period
from tillwise.schemas import FIRST_DAY, PARTITION_COLUMN, PARTITIONED_FACTS, WAREHOUSE
from tillwise.sources.store import Store

VERSIONED = ("dim_address", "dim_customer", "dim_product", "dim_order_state")


class Warehouse:
    """Tables by attribute (``dw.fact_order``), each looked up at its first use.

    ``first_day`` is the day numbered 1 in ``dim_date``, if its keys number the days in order.
    """

    def __init__(self, tables: Callable[[str], DataFrame], first_day: dt.date | None = None):
        self._tables = tables
        self.first_day = first_day

    def __getattr__(self, name: str) -> DataFrame:
        if name not in WAREHOUSE:
            raise AttributeError(name)
        table = self._tables(name)
        setattr(self, name, table)
        return table

    def within(self, fact: DataFrame, period: Period, *date_columns: str) -> DataFrame:
        """Fact rows whose day lies in the period, with the wanted ``dim_date`` columns.

        The period reaches the scan twice: as partition bounds on the month and as a range of date keys, both known
        when the query is planned. The join decides; ``dim_date`` is bounded by the calendar and is broadcast.
        """
        if PARTITION_COLUMN in fact.columns:
            fact = fact.filter(F.col(PARTITION_COLUMN).between(*period.months))
        if self.first_day:
            keys = (key_of_day(day, self.first_day) for day in (period.start, period.end))
            fact = fact.filter(F.col("date_sk").between(*keys))
        days = self.dim_date.filter(period.contains(F.col("date"))).select(
            F.col("date_key").alias("date_sk"), *date_columns
        )
        return fact.join(F.broadcast(days), "date_sk")


def read_warehouse(store: Store) -> Warehouse:
    """Star schema kept in a store."""

    def table(name: str) -> DataFrame:
        schema = WAREHOUSE[name]
        if name in VERSIONED:
            return store.versions(name, schema)
        if name in PARTITIONED_FACTS:
            return store.appended(name, schema, PARTITION_COLUMN)
        if name.startswith("bridge"):
            return store.appended(name, schema)
        return store.replaced(name, schema)

    return Warehouse(table, FIRST_DAY)
