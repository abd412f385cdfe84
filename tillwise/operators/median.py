"""Exact median over any number of rows with a bounded amount of state per task."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A decimal(20,6) is split into its whole part, shifted to be positive (below 2 * 10^14, i.e. two groups of 24 bits),
# and its millionths.
_SHIFT = 10**14
_GROUP_BITS = 24
_GROUPS = 3


def exact_median(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row: the median of a money column, interpolated between the two middle values; NULL without rows.

    ``percentile`` would keep every distinct value in one task. Here the values are first counted (combined map-side),
    then the two middle ranks are narrowed down digit group by digit group: each step builds a histogram of at most
    2^24 bins per rank for a running total. The counted values are shuffled once and reused by all steps.
    """
    value = F.col(column).cast("decimal(20,6)")
    whole = F.floor(value)
    counted = (
        df.filter(F.col(column).isNotNull())
        .select(
            whole.cast("long").alias("_whole"), ((value - whole) * F.lit(10**6)).cast("int").alias("_millionths")
        )
        .groupBy("_whole", "_millionths")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    shifted = F.col("_whole") + F.lit(_SHIFT)
    digits = [
        F.shiftright(shifted, _GROUP_BITS), shifted.bitwiseAND(F.lit((1 << _GROUP_BITS) - 1)), F.col("_millionths")
    ]
    # coalesce: without it the optimizer adds a different NULL filter per step and the shuffle is not reused.
    values = counted.select(
        "_n", *[F.coalesce(digit.cast("long"), F.lit(0)).alias(f"_d{i}") for i, digit in enumerate(digits)]
    )

    wanted = None  # the digits found so far and the rank left among their values: one row per middle rank
    path: list[str] = []
    for level in range(_GROUPS):
        digit = f"_d{level}"
        if wanted is None:
            bins = values.groupBy(digit).agg(F.sum("_n").alias("_n"))
            in_order = Window.orderBy(digit)
            total = F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            ranks = F.array(F.floor((total + 1) / 2), F.floor((total + 2) / 2))
        else:
            bins = (
                values.join(F.broadcast(wanted), path)  # two rows
                .groupBy("_target", "_rank", *path, digit)
                .agg(F.sum("_n").alias("_n"))
            )
            in_order = Window.partitionBy("_target").orderBy(digit)
            ranks = None
        upto = F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto")
        if ranks is not None:
            placed = bins.select("*", upto, ranks.alias("_ranks")).select(
                *path, digit, "_n", "_upto", F.posexplode("_ranks").alias("_target", "_rank")
            )
        else:
            placed = bins.select("*", upto)
        before = F.col("_upto") - F.col("_n")
        hit = placed.filter((F.col("_upto") >= F.col("_rank")) & (before < F.col("_rank")))
        path = [*path, digit]
        wanted = hit.select("_target", (F.col("_rank") - before).alias("_rank"), *path)

    whole = F.shiftleft("_d0", _GROUP_BITS) + F.col("_d1") - F.lit(_SHIFT)
    millionths = whole.cast("decimal(15,0)") * F.lit(10**6) + F.col("_d2").cast("decimal(7,0)")
    # Two rows; half a millionth of their sum is exact with one decimal place more than the values have.
    total = F.sum(millionths).cast("decimal(24,0)")
    return wanted.agg((total * F.lit(Decimal("0.0000005"))).cast("decimal(22,7)").alias(name))
