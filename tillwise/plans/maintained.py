"""Dashboard figures from day-grained sums that are kept up to date by signed changes.

Each view is the sum of a product over joined tables, so it is linear in each of them: a batch that adds rows (weight 1) and
withdraws rows (weight -1) changes it by sums over the batch joined with the other tables, never over old rows joined with
old rows. Late and withdrawn payments are history rows added and withdrawn later; a correction is a withdrawal and an addition.

* ``orders_per_hour`` (date_sk, time_sk): orders
* ``paid_per_order_day`` (date_sk of the order): paid marks, revenue
* ``paid_per_day_carrier`` (date_sk of the payment, carrier): paid marks, revenue
* ``paid_per_day_product`` (date_sk of the payment, product_sk): line and mark pairs, revenue

A key whose count comes to 0 leaves its view. Views have at most days times 24, 1, carriers or products rows; a report reads
those of its period and joins no fact.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.cleanse import labelled
from tillwise.operators.trend import linear_trend
from tillwise.plans import reports
from tillwise.plans.periods import Period
from tillwise.plans.warehouse import Warehouse
from tillwise.schemas import PAID_STATE

WEIGHT = "_weight"
#: Keys and sums of the views; the first sum counts, and a key without a count is gone.
VIEWS = {
    "orders_per_hour": (["date_sk", "time_sk"], ["orders"]),
    "paid_per_order_day": (["date_sk"], ["marks", "revenue"]),
    "paid_per_day_carrier": (["date_sk", "carrier"], ["marks", "revenue"]),
    "paid_per_day_product": (["date_sk", "product_sk"], ["pairs", "revenue"]),
}
_ORDERS = ["orderid_bk", "date_sk", "time_sk", "paid_tax_incl", "carrier"]
_HISTORY = ["orderid_bk", "date_sk", "orderstateid_bk"]
_LINES = ["orderid_bk", "product_sk", "amount_tax_incl"]
_SUM = "decimal(38,6)"


def weighted(added: DataFrame | None, withdrawn: DataFrame | None = None) -> DataFrame:
    """Rows with the weight 1 and rows with the weight -1, in one frame."""
    parts = [df.withColumn(WEIGHT, F.lit(w).cast("long")) for df, w in ((added, 1), (withdrawn, -1)) if df is not None]
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Facts:
    """Weighted rows of fact_order, fact_order_history and fact_order_line: a whole state or one batch of changes."""

    orders: DataFrame
    history: DataFrame
    lines: DataFrame

    def plus(self, change: Facts) -> Facts:
        return Facts(*[getattr(self, n).select(*c, WEIGHT).unionByName(getattr(change, n).select(*c, WEIGHT)) for n, c in _TABLES])


_TABLES = (("orders", _ORDERS), ("history", _HISTORY), ("lines", _LINES))


def _marks(history: DataFrame) -> DataFrame:
    """Net paid marks per order and day: (orderid_bk, paid_day, w)."""
    paid = history.filter(F.col("orderstateid_bk") == PAID_STATE)
    return paid.groupBy("orderid_bk", F.col("date_sk").alias("paid_day")).agg(F.sum(WEIGHT).alias("w")).filter("w <> 0")


def _times(value: str, count: Column) -> Column:
    return F.col(value) * count.cast("decimal(18,0)")


def _summed(rows: DataFrame, view: str) -> DataFrame:
    keys, sums = VIEWS[view]
    types = ["long"] + [_SUM] * (len(sums) - 1)
    return rows.groupBy(*keys).agg(*[F.sum(c).cast(t).alias(c) for c, t in zip(sums, types)])


def _order_payments(orders: DataFrame, marks: DataFrame) -> DataFrame:
    pairs = orders.select(*_ORDERS, WEIGHT).join(marks, "orderid_bk")
    net = F.col(WEIGHT) * F.col("w")
    return pairs.select("date_sk", "paid_day", "carrier", net.alias("marks"), _times("paid_tax_incl", net).alias("revenue"))


def _line_payments(lines: DataFrame, marks: DataFrame) -> DataFrame:
    pairs = lines.select(*_LINES, WEIGHT).join(marks, "orderid_bk")
    net = F.col(WEIGHT) * F.col("w")
    return pairs.select(F.col("paid_day").alias("date_sk"), "product_sk", net.alias("pairs"), _times("amount_tax_incl", net).alias("revenue"))


def changes(before: Facts, batch: Facts, wanted: Iterable[str] = VIEWS) -> dict[str, DataFrame]:
    """What a batch changes in each of the wanted views: the batch's orders and lines with the marks there were, and all orders and lines
    there are now with the batch's marks."""
    after, old, new = before.plus(batch), _marks(before.history), _marks(batch.history)
    paid = _order_payments(batch.orders, old).unionByName(_order_payments(after.orders, new))
    by_line = _line_payments(batch.lines, old).unionByName(_line_payments(after.lines, new))
    by_payment = paid.select(F.col("paid_day").alias("date_sk"), "carrier", "marks", "revenue")
    rows = {
        "orders_per_hour": batch.orders.select("date_sk", "time_sk", F.col(WEIGHT).alias("orders")),
        "paid_per_order_day": paid,
        "paid_per_day_carrier": by_payment,
        "paid_per_day_product": by_line,
    }
    return {view: _summed(rows[view], view) for view in wanted}


def applied(views: dict[str, DataFrame], change: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The views after a change. Combining is a sum, so several changes may also be added up first and applied as one.

    In a change, a count of 0 says nothing: one row may have come for another. In a view, no row is left behind it.
    """
    after = {view: _summed(df.unionByName(change[view]), view) for view, df in views.items()}
    return {view: df.filter(F.col(VIEWS[view][1][0]) != 0) for view, df in after.items()}


def loaded(first: Facts, wanted: Iterable[str] = VIEWS) -> dict[str, DataFrame]:
    """The wanted views of a first load."""
    nothing = Facts(*[getattr(first, n).limit(0) for n, _ in _TABLES])
    made = changes(nothing, first, wanted)
    return applied({view: df.limit(0) for view, df in made.items()}, made)


# The dashboard, as ``plans.reports`` has it, from the views.


def orders_count(views: dict[str, DataFrame], dw: Warehouse, period: Period) -> DataFrame:
    found = dw.within(views["orders_per_hour"], period)
    return found.agg(F.coalesce(F.sum("orders"), F.lit(0)).alias("orders_count"))


def orders_paid(views: dict[str, DataFrame], dw: Warehouse, period: Period) -> DataFrame:
    found = dw.within(views["paid_per_order_day"], period)
    return found.agg(F.coalesce(F.sum("marks"), F.lit(0)).alias("orders_paid_count"), F.sum("revenue").alias("total_revenue"))


def summary(views: dict[str, DataFrame], carts: DataFrame, dw: Warehouse, period: Period) -> DataFrame:
    """The six key figures; ``carts`` is the one-row count of carts, see ``plans.cart_days``."""
    return reports.key_figures(orders_count(views, dw, period), orders_paid(views, dw, period), carts)


def period_revenue(views: dict[str, DataFrame], dw: Warehouse, period: Period) -> DataFrame:
    found = dw.within(views["paid_per_day_carrier"], period, "date")
    return found.groupBy(period.label(F.col("date")).alias("period")).agg(F.sum("revenue").alias("total_revenue")).orderBy("period")


def period_revenue_trend(views: dict[str, DataFrame], dw: Warehouse, period: Period) -> DataFrame:
    rounded = period_revenue(views, dw, period).withColumn("total_revenue", F.bround("total_revenue", 0))
    return linear_trend(rounded, "period", "total_revenue").orderBy("period")


def orders_heatmap(views: dict[str, DataFrame], dw: Warehouse, period: Period) -> DataFrame:
    return reports.heatmap_of(dw, dw.within(views["orders_per_hour"], period))


def heatmap_matrix(views: dict[str, DataFrame], dw: Warehouse, period: Period) -> DataFrame:
    return reports.matrix_of(orders_heatmap(views, dw, period))


def carrier_revenue(views: dict[str, DataFrame], dw: Warehouse, period: Period) -> DataFrame:
    found = dw.within(views["paid_per_day_carrier"], period).groupBy("carrier")
    sums = found.agg(F.sum("revenue").alias("total_revenue"), F.sum("marks").alias("total_count"))
    return sums.orderBy(F.desc_nulls_first("total_revenue"), F.asc_nulls_last("carrier")).withColumn("carrier", labelled(F.col("carrier")))


def _by_product(views: dict[str, DataFrame], dw: Warehouse, period: Period, attribute: str) -> DataFrame:
    per_product = dw.within(views["paid_per_day_product"], period).groupBy("product_sk").agg(F.sum("revenue").alias("revenue"))
    return reports.revenue_by_attribute(dw, per_product, attribute)


def top_manufacturers(views: dict[str, DataFrame], dw: Warehouse, period: Period, count: int = reports.TOP_MANUFACTURERS) -> DataFrame:
    return reports.best_first(_by_product(views, dw, period, "manufacturer"), "manufacturer").limit(count)


def market_group_revenue(views: dict[str, DataFrame], dw: Warehouse, period: Period) -> DataFrame:
    return reports.best_first(_by_product(views, dw, period, "market_group"), "market_group")


def market_group_share(views: dict[str, DataFrame], dw: Warehouse, period: Period) -> DataFrame:
    return reports.share_of(_by_product(views, dw, period, "market_group"), "market_group")
