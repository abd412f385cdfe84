"""CSV export of a report and paged reading of an export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.operators.listing import last_page, page_bounds
from tillwise.operators.ordering import number_rows

BLOCK_ROWS = 100_000

# NULL is written as nothing and an empty text as "". On reading, what stands for NULL must differ from both.
TEXT = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
WRITING = TEXT | {"nullValue": "", "emptyValue": '""'}
READING = TEXT | {"nullValue": "\0", "emptyValue": "", "multiLine": True}


@dataclass(frozen=True)
class Export:
    path: str
    columns: list[str]
    total_rows: int
    block_rows: int
    schema: T.StructType


def export_csv(df: DataFrame, path: str, order_by: list[Column], block_rows: int = BLOCK_ROWS) -> Export:
    """Write ``df`` in order as CSV files with one header line each.

    ``order_by`` must be a total order. Rows are grouped into consecutive blocks of ``block_rows``, one folder per
    block, so that a page is later read from the one or two blocks that hold it, however deep it lies.
    """
    counted = Observation("export")
    blocks = number_rows(df, order_by, "row_number").withColumn(
        "block", F.floor((F.col("row_number") - 1) / block_rows).cast("long")
    )
    (
        blocks.drop("row_number")
        .observe(counted, F.count(F.lit(1)).alias("total_rows"))
        .write.mode("overwrite")
        .partitionBy("block")
        .options(**WRITING)
        .csv(path)
    )
    return Export(path, df.columns, counted.get["total_rows"], block_rows, df.schema)


def read_csv(spark: SparkSession, export: Export) -> DataFrame:
    schema = T.StructType(export.schema.fields + [T.StructField("block", T.LongType())])
    if export.total_rows == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**READING).csv(export.path)


def csv_page(
    spark: SparkSession, export: Export, order_by: list[Column], page: int = 1, page_size: int = 10
) -> tuple[DataFrame, int]:
    """Rows of one page and the number of the last page."""
    first, size = page_bounds(page, page_size)
    first_block = first // export.block_rows
    last_block = (first + size - 1) // export.block_rows
    rows = (
        read_csv(spark, export)
        .filter(F.col("block").between(first_block, last_block))
        .drop("block")
        .orderBy(*order_by)
        .offset(first - first_block * export.block_rows)
        .limit(size)
    )
    return rows, last_page(export.total_rows, size)
