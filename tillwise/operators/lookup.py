"""Surrogate-key lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.operators.joins import attach
from tillwise.schemas import FIRST_DAY, OPEN_END, PARTITION_COLUMN


def lookup_key(
    df: DataFrame,
    dim: DataFrame,
    on: dict[str, str],
    key: str,
    alias: str,
    current_only: bool = True,
    hot_from: DataFrame | None = None,
) -> DataFrame:
    """Add ``alias``: the surrogate ``key`` of the dimension row matching ``on`` (df column -> dim column).

    One version per business key is used: the current one, or with ``current_only=False`` the current one if there is
    any and otherwise the one with the highest key. Unresolved keys give NULL; the caller drops or keeps them.
    """
    is_open = F.col("valid_to") == F.lit(OPEN_END)
    wanted = F.max(F.when(is_open, F.col(key)))
    if current_only:
        dim = dim.filter(is_open)
    else:
        wanted = F.coalesce(wanted, F.max(key))
    one_per_key = dim.groupBy(*[F.col(there).alias(here) for here, there in on.items()]).agg(wanted.alias(alias))
    return attach(df, one_per_key, list(on), hot_from)


def calendar_keys(df: DataFrame, moment: str, dim_date: DataFrame, dim_time: DataFrame) -> DataFrame:
    """Add ``date_sk`` and ``time_sk`` of the UTC day and hour of ``moment`` (0 when there is none), and the physical
    partition column.

    Both calendar dimensions are bounded by the calendar itself (24 hours; 366 days a year), hence the broadcasts.
    """
    days = F.broadcast(dim_date.select(F.col("date").alias("_day"), "date_key", "year", "month"))
    hours = F.broadcast(dim_time.select(F.col("hour").alias("_hour"), "time_key"))
    at = F.col(moment).cast("timestamp")
    zero = F.lit(0).cast("long")
    return (
        df.withColumn("_day", F.to_date(at))
        .withColumn("_hour", F.hour(at))
        .join(days, "_day", "left")
        .join(hours, "_hour", "left")
        .withColumn("date_sk", F.coalesce("date_key", zero))
        .withColumn("time_sk", F.coalesce("time_key", zero))
        .withColumn(PARTITION_COLUMN, F.coalesce(F.col("year") * 100 + F.col("month"), F.lit(0)).cast("int"))
        .drop("_day", "_hour", "date_key", "time_key", "year", "month")
    )


def key_of_day(day, first_day=FIRST_DAY):
    """Date key of a day: days are numbered from 1 in calendar order."""
    return (day - first_day).days + 1
