"""Layouts of type-2 dimensions: current rows in sorted buckets, versions by the year they end.

The current rows are a table bucketed and sorted by the business key, so a load deals only the stage rows, to the same
buckets, and merges them with files that stay where they are. Versions are partitioned by the year of ``valid_to``: a
report on versions valid in a period skips all that ended in earlier years without opening them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.plans.dimensions import Dimension
from tillwise.plans.periods import Period
from tillwise.schemas import OPEN_END
from tillwise.sources.readers import TableReader

END_YEAR = "end_year"


def save_current(rows: DataFrame, table: str, dimension: Dimension, buckets: int, path: str) -> DataFrame:
    """Write open rows as the bucketed table ``table`` under ``path``, one file per bucket, and read it."""
    dealt = rows.filter(F.col("valid_to") == F.lit(OPEN_END)).repartition(buckets, *dimension.bk)
    writer = dealt.write.bucketBy(buckets, *dimension.bk).sortBy(*dimension.bk).format("parquet").option("path", path)
    writer.mode("overwrite").saveAsTable(table)
    return rows.sparkSession.table(table)


def buckets_of(spark: SparkSession, table: str) -> int:
    """Number of buckets the catalog has for a table."""
    found = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Num Buckets'").first()
    if found is None:
        raise ValueError(f"{table} has no buckets")
    return int(found["data_type"])


def step(dimension: Dimension, stage: TableReader, table: str, as_of: dt.date, spark: SparkSession) -> DataFrame:
    """``Dimension.step`` against a bucketed table: stage rows are dealt to its buckets, its own rows don't move."""
    buckets = buckets_of(spark, table)
    dealt = replace(dimension, rows=lambda read: dimension.rows(read).repartition(buckets, *dimension.bk))
    return dealt.step(stage, spark.table(table), as_of)


def save_versions(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write versions by the year they end; open ones are the year 9999."""
    by_year = rows.withColumn(END_YEAR, F.year("valid_to")).hint("rebalance", END_YEAR)
    by_year.sortWithinPartitions("valid_from").write.mode(mode).partitionBy(END_YEAR).parquet(path)


def valid_in(versions: DataFrame, period: Period) -> DataFrame:
    """Versions valid at some day of the period. The year prunes folders, the sorted ``valid_from`` row groups."""
    recent = F.col(END_YEAR) >= F.lit(period.start.year)
    return versions.filter(recent & period.overlaps()).drop(END_YEAR)
