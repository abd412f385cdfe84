"""Reporting periods: the single place for period logic."""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_LABEL = "yyyy-MM-dd"
MONTH_LABEL = "MM"


@dataclass(frozen=True)
class Period:
    start: dt.date
    end: dt.date
    label_format: str

    def contains(self, day: Column) -> Column:
        return day.between(F.lit(self.start), F.lit(self.end))

    def overlaps(self, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
        """Rows valid at some day of the period."""
        return (F.col(valid_from) <= F.lit(self.end)) & (F.col(valid_to) >= F.lit(self.start))

    def label(self, day: Column) -> Column:
        return F.date_format(day, self.label_format)

    @property
    def months(self) -> tuple[int, int]:
        """First and last month as yyyymm, the partition bounds of the facts."""
        return self.start.year * 100 + self.start.month, self.end.year * 100 + self.end.month


def _two_numbers(value: str) -> tuple[int, int] | None:
    try:
        first, second = value.split("-")[:2]
        return int(first), int(second)
    except ValueError:
        return None


def _months(year: int, first: int, last: int, label: str) -> Period:
    return Period(dt.date(year, first, 1), dt.date(year, last, calendar.monthrange(year, last)[1]), label)


def _check(name: str, number: int, most: int) -> None:
    if not 1 <= number <= most:
        raise ValueError(f"there is no {name} {number}; it must lie between 1 and {most}")


def period(
    kind: str | None = None,
    value: str | None = None,
    start: str | None = None,
    end: str | None = None,
    *,
    as_of: dt.date,
) -> Period:
    """Period of a request: ``month`` Y-M, ``quarter`` Y-Q, ``year`` Y or ``range`` start/end.

    Unreadable numbers fall back to the period holding ``as_of``; a range needs both bounds, in order. Numbers that name
    no period, such as quarter 5, raise ``ValueError``.
    """
    kind = kind or "year"
    value = str(as_of.year) if value is None else value
    if kind == "range":
        if not start or not end:
            raise ValueError("a range needs both bounds")
        try:
            first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
        except ValueError:
            return Period(as_of, as_of, DAY_LABEL)
        if last < first:
            raise ValueError(f"the range ends on {last}, before its start on {first}")
        return Period(first, last, DAY_LABEL)
    if kind == "month" and value:
        year, month = _two_numbers(value) or (as_of.year, as_of.month)
        _check("month", month, 12)
        _check("year", year, 9999)
        return _months(year, month, month, DAY_LABEL)
    if kind == "quarter" and value:
        year, quarter = _two_numbers(value) or (as_of.year, (as_of.month + 2) // 3)
        _check("quarter", quarter, 4)
        _check("year", year, 9999)
        return _months(year, quarter * 3 - 2, quarter * 3, MONTH_LABEL)
    try:
        year = int(value)
    except ValueError:
        year = as_of.year
    _check("year", year, 9999)
    return _months(year, 1, 12, MONTH_LABEL)
