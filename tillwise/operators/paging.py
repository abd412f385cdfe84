"""Deep pages of a large listing by an order-statistic index.

The index holds every ``block_rows``-th row of the listing in its order: the sort value and the id, and with it how many
rows lie before. A page is then found between two neighbouring entries by comparing sort values, which scans can use, and
only that block is sorted; a page far down costs what the first one costs.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.operators.listing import last_page, page_bounds
from tillwise.operators.ordering import number_rows
from tillwise.sources.scratch import written

BLOCK_ROWS = 10_000


@dataclass(frozen=True)
class PageIndex:
    """``entries`` has (row_number, value, tie) of the rows 1, 1 + block_rows, 1 + 2 * block_rows and so on."""

    sort_field: str
    descending: bool
    tie_break: str
    block_rows: int
    total_rows: int
    entries: DataFrame

    def order(self) -> list[Column]:
        return _order(self.sort_field, self.descending, self.tie_break)

    @property
    def blocks(self) -> int:
        return -(-self.total_rows // self.block_rows)


def _order(sort_field: str, descending: bool, tie_break: str) -> list[Column]:
    column = F.col(sort_field)
    return [column.desc_nulls_first() if descending else column.asc_nulls_last(), F.col(tie_break).desc()]


def page_index(
    df: DataFrame, sort_field: str = "id", sort_dir: str = "desc", block_rows: int = BLOCK_ROWS, tie_break: str = "id"
) -> PageIndex:
    """Index of a listing for one order; ``tie_break`` is a unique id. It holds as long as the rows stay as they are.

    Only the sort value and the id are sorted, range partitioned. NULLs sort as in ``listing.page_rows``.
    """
    descending = sort_dir.lower() != "asc"
    keys = df.select(F.col(sort_field).alias("value"), F.col(tie_break).alias("tie"))
    numbered = number_rows(keys, _order("value", descending, "tie"), "row_number")
    total = F.max("row_number").alias("total")
    entries = written(numbered.filter((F.col("row_number") - 1) % block_rows == 0).select("row_number", "value", "tie"), "page-index")
    return PageIndex(sort_field, descending, tie_break, block_rows, numbered.agg(total).first()["total"] or 0, entries)


def _from_entry(index: PageIndex, value: Any, tie: Any) -> Column:
    """Rows at or behind an entry in the order of the listing."""
    column, id_ = F.col(index.sort_field), F.col(index.tie_break)
    if value is None:
        same = column.isNull() & (id_ <= F.lit(tie))
        return (same | column.isNotNull()) if index.descending else same
    beyond = column < F.lit(value) if index.descending else (column > F.lit(value)) | column.isNull()
    return F.coalesce(beyond | ((column == F.lit(value)) & (id_ <= F.lit(tie))), F.lit(False))


def block_of_pages(df: DataFrame, index: PageIndex, first: int, last: int) -> DataFrame:
    """The rows of the blocks that hold the rows ``first`` to ``last`` (from 0): at most a page and two blocks."""
    low, high = first // index.block_rows, last // index.block_rows + 1
    wanted = [low * index.block_rows + 1, high * index.block_rows + 1]
    found = {r["row_number"]: r for r in index.entries.filter(F.col("row_number").isin(wanted)).collect()}
    if wanted[0] not in found:
        return df.limit(0)
    rows = df.filter(_from_entry(index, found[wanted[0]]["value"], found[wanted[0]]["tie"]))
    if wanted[1] in found:
        rows = rows.filter(~_from_entry(index, found[wanted[1]]["value"], found[wanted[1]]["tie"]))
    return rows


def seek_page(df: DataFrame, index: PageIndex, page: int = 1, page_size: int = 10) -> tuple[DataFrame, int]:
    """Rows of one page, as ``listing.page_rows`` gives them, and the number of the last page."""
    first, size = page_bounds(page, page_size)
    block = block_of_pages(df, index, first, first + size - 1)
    rows = block.orderBy(*index.order()).offset(first % index.block_rows).limit(size)
    return rows, last_page(index.total_rows, size)
