"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day parts and their hour ranges, and the display order of both heatmap axes.
DAY_PARTS = (("Morning", 6, 11), ("Afternoon", 12, 17), ("Evening", 18, 23))
OTHER_DAY_PART = "Night"
DAY_PART_ORDER = ("Morning", "Afternoon", "Evening", "Night")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def day_part(hour: Column) -> Column:
    out = F.lit(OTHER_DAY_PART)
    for name, first, last in DAY_PARTS:
        out = F.when(hour.between(first, last), F.lit(name)).otherwise(out)
    return out


def position_in(column: Column, values: tuple[str, ...]) -> Column:
    """1-based place of a value in a fixed list, for semantic ordering."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), column)


def full_years(birth: Column, today: Column) -> Column:
    """Completed years of age; a 29 February birthday counts from 1 March in common years."""
    before_birthday = F.date_format(today, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(today) - F.year(birth) - before_birthday.cast("int")


def age_decade(birth: Column, today: Column) -> Column:
    return (F.floor(full_years(birth, today) / 10) * 10).cast("long")
