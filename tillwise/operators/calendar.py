"""Generated calendar dimensions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.schemas import FIRST_DAY, WAREHOUSE

# The calendar holds these days from the start; a load appends the years that its data reaches into.
LAST_DAY = dt.date(2030, 12, 31)


def day_attributes(days: DataFrame, day: str = "date") -> DataFrame:
    """Calendar attributes of each day, numbered from 1 at the earliest day of ``first_day``."""
    date = F.col(day)
    weekday = F.weekday(date) + 1
    return days.select(
        F.col("date_key").cast("long").alias("date_key"),
        date.alias("date"),
        F.year(date).alias("year"),
        F.quarter(date).alias("quarter"),
        F.month(date).alias("month"),
        F.date_format(date, "MMMM").alias("month_name"),
        F.dayofmonth(date).alias("day"),
        weekday.alias("day_of_week"),
        F.date_format(date, "EEEE").alias("day_name"),
        F.weekofyear(date).alias("week_of_year"),
        weekday.isin(6, 7).alias("is_weekend"),
    )


def date_frame(spark: SparkSession, start: dt.date = FIRST_DAY, end: dt.date = LAST_DAY) -> DataFrame:
    """One row per day from ``start`` to ``end``; keys number the days from 1."""
    offset = F.col("id").cast("int")
    days = spark.range((end - start).days + 1).select(
        (F.col("id") + 1).alias("date_key"), F.date_add(F.lit(start), offset).alias("date")
    )
    return day_attributes(days)


def date_frame_between(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """One row per day between two columns of a one-row frame."""
    series = F.sequence(F.col(start).cast("date"), F.col(end).cast("date"), F.expr("INTERVAL 1 DAY"))
    days = bounds.select(F.posexplode(series).alias("position", "date"))
    return day_attributes(days.withColumn("date_key", F.col("position") + 1))


def time_frame(spark: SparkSession) -> DataFrame:
    """The 24 hours of a day; the time of day is kept as ``HH:mm:ss`` text."""
    hour = F.col("id").cast("int")
    return spark.range(24).select(
        (F.col("id") + 1).alias("time_key"),
        F.format_string("%02d:00:00", hour).alias("time"),
        hour.alias("hour"),
    ).select(*WAREHOUSE["dim_time"].names)
