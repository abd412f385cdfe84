"""Distinct carts of any period from a small state: a bitmap of cart ids per day.

A cart with lines on several days counts once in a period, so counts per day can't be added; bitmaps can be merged. The
state is kept per load: the bitmaps of new lines are appended, and days and buckets that occur twice merge when read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillwise.operators.id_bitmaps import count_ids, id_bitmaps
from tillwise.plans.periods import Period
from tillwise.plans.warehouse import Warehouse
from tillwise.schemas import PARTITION_COLUMN


def cart_days(lines: DataFrame) -> DataFrame:
    """State of some cart lines: (date_sk[, date_month], id_bucket, id_bits)."""
    physical = [PARTITION_COLUMN] if PARTITION_COLUMN in lines.columns else []
    return id_bitmaps(lines, "cartid_bk", "date_sk", *physical)


def carts_count(state: DataFrame, dw: Warehouse, period: Period) -> DataFrame:
    """Distinct carts with a line in the period, as ``reports.carts_count`` gives them, without reading a line."""
    return count_ids(dw.within(state, period), "carts_count")
