"""Filtered, sorted and paged listings of the run log, the report catalog and the user table."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The comparison operators a listing offers.
COMPARISONS: dict[str, Callable[[Column, Any], Column]] = {
    "like": lambda column, value: column.cast("string").like(f"%{value}%"),
    ">": lambda column, value: column > value,
    "<": lambda column, value: column < value,
    "=": lambda column, value: column == value,
    "<=": lambda column, value: column <= value,
}
DEFAULT_PAGE_SIZE = 10

Filter = tuple[str, str, Any]  # (field, comparison, value)


def page_bounds(page: int, page_size: int) -> tuple[int, int]:
    """Offset of the first row and page size."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    return (page - 1) * page_size, page_size


def last_page(total: int, page_size: int) -> int:
    return -(-total // page_size)


def filtered(df: DataFrame, filters: Iterable[Filter] = (), user_id: int | None = None) -> DataFrame:
    """Rows meeting all filters; ``user_id`` restricts a non-admin to their own rows."""
    for field, comparison, value in filters:
        _known(df, field)
        if comparison not in COMPARISONS:
            raise ValueError(f"unknown comparison {comparison!r}")
        df = df.filter(COMPARISONS[comparison](F.col(field), value))
    return df if user_id is None else df.filter(F.col("user_id") == user_id)


def page_rows(
    df: DataFrame, sort_field: str = "id", sort_dir: str = "desc", page: int = 1, page_size: int = DEFAULT_PAGE_SIZE,
    tie_break: str = "id",
) -> DataFrame:
    """One page of a listing, as a bounded top-k.

    NULLs sort as in the usual relational database: last ascending, first descending. For paging deep into large
    results use ``sources.csv_export``, which reads only the block holding the page.
    """
    _known(df, sort_field)
    first, size = page_bounds(page, page_size)
    column = F.col(sort_field)
    order = column.asc_nulls_last() if sort_dir.lower() == "asc" else column.desc_nulls_first()
    ties = [F.col(tie_break).desc()] if tie_break in df.columns and tie_break != sort_field else []
    return df.orderBy(order, *ties).offset(first).limit(size)


def page_count(df: DataFrame, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Number of rows and number of the last page, as one row."""
    return df.agg(F.count(F.lit(1)).alias("total_records")).select(
        "total_records", F.ceil(F.col("total_records") / page_size).cast("long").alias("last_page")
    )


def _known(df: DataFrame, field: str) -> None:
    if field not in df.columns:
        raise ValueError(f"unknown field {field!r}")
