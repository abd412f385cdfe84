"""Linear trend over a short aggregated series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linear_trend(df: DataFrame, order_col: str, y: str, name: str = "lin_reg") -> DataFrame:
    """Add the least-squares line through (0, y0), (1, y1), ... in ``order_col`` order; one row gives a flat line.

    ``df`` is an aggregated series of at most a few thousand periods, so the one-partition window is bounded.
    """
    series = Window.orderBy(order_col)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x, value = F.col("_x"), F.col(y).cast("double")
    slope = F.coalesce(F.regr_slope(value, x).over(whole), F.lit(0.0))
    intercept = F.coalesce(F.regr_intercept(value, x).over(whole), F.avg(value).over(whole))
    return (
        df.withColumn("_x", (F.row_number().over(series) - 1).cast("double"))
        .withColumn(name, slope * x + intercept)
        .drop("_x")
    )
