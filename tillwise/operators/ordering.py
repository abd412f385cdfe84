"""Global row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.session import ensure_checkpoint_dir

_ROWS_PER_PARTITION_BITS = 33  # layout of monotonically_increasing_id


def number_rows(df: DataFrame, order_by: list[Column], name: str) -> DataFrame:
    """Number the rows 1..n in the given total order.

    The sort is range partitioned. Each row remembers its partition and place; the only global step is a running total
    over the partition sizes, one row per partition. The sorted rows are checkpointed, so that a recomputed task
    cannot move a row to another place between the two reads.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.orderBy(*order_by).withColumn("_place", F.monotonically_increasing_id()).checkpoint()
    partition = F.shiftright("_place", _ROWS_PER_PARTITION_BITS)
    placed = placed.withColumn("_part", partition)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    place = F.col("_place").bitwiseAND(F.lit((1 << _ROWS_PER_PARTITION_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")  # one row per sort partition
        .withColumn(name, F.col("_before") + place + 1)
        .drop("_part", "_place", "_before")
    )
