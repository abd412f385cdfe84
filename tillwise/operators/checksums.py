"""Comparison of two large tables that narrows down to the key ranges that differ.

Both tables are summed up per range of a whole-number key: rows and row hashes, which don't depend on the order. Equal ranges
are done with. The others are cut into smaller ranges and summed up again, reading only them, until ranges are short or too
many differ; what is left is compared field by field (``operators.reconcile``). Equal ranges are read once and shuffle a few
numbers; tables that differ all over cost one pass more than comparing them at once.

Two different ranges are taken for equal only if 64 bits of hash sums and the number of rows agree.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.operators.reconcile import reconcile

#: Ranges of the first level, and of each range on the next.
FIRST, FANOUT = 4096, 64
#: Ranges with so many keys are not cut any more.
SHORT = 1024
#: Differing ranges are told to the scans as at most so many intervals; close ones are joined. Every interval is two more
#: comparisons of every row, and some hundred of them make the generated code too long to be compiled.
INTERVALS = 16
#: With more differing ranges than this, or more than this share of the keys in them, there is no use in narrowing further.
MANY, MOST = 4096, 0.5


@dataclass(frozen=True)
class Ranges:
    """Key intervals (first, last) that may differ, and whether rows without a key may."""

    intervals: tuple[tuple[int, int], ...]
    keyless: bool
    #: The ranges among the intervals, where these hold others too: (lowest key, width, numbers).
    numbers: tuple[int, int, tuple[int, ...]] | None = None

    def holds(self, key: str) -> Column:
        """Plain comparisons, which scans use to skip files and row groups, and one look-up of the range for each row left."""
        held = reduce(or_, [F.col(key).between(first, last) for first, last in self.intervals], F.lit(False))
        if self.numbers:
            low, width, numbers = self.numbers
            held &= F.expr(f"{_range(key, low, width)} IN ({', '.join(f'{n}L' for n in numbers)})")
        return held | F.col(key).isNull() if self.keyless else held


def _range(key: str, low: int, width: int) -> str:
    """Number of the range that holds a key; whole numbers all through, so it is exact for every key."""
    return f"((CAST(`{key}` AS BIGINT) - CAST('{low}' AS BIGINT)) DIV {width}L)"


def _joined(starts: list[int], width: int, most: int = INTERVALS) -> tuple[tuple[int, int], ...]:
    """Ranges as intervals; the widest gaps between them stay."""
    starts = sorted(starts)
    gaps = sorted(range(1, len(starts)), key=lambda k: starts[k - 1] + width - starts[k])[: most - 1]
    cuts = sorted(k for k in gaps if starts[k] > starts[k - 1] + width)
    bounds = [0, *cuts, len(starts)]
    return tuple((starts[a], starts[b - 1] + width - 1) for a, b in zip(bounds, bounds[1:])) if starts else ()


def range_sums(df: DataFrame, key: str, low: int, width: int, sign: int) -> DataFrame:
    """(``_range``, and signed sums of rows and of both halves of the row hashes) of all columns of ``df``."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    half = F.lit(0xFFFFFFFF)
    return df.select(
        F.expr(_range(key, low, width)).alias("_range"),
        F.lit(sign).cast("long").alias("_rows"),
        (row.bitwiseAND(half) * sign).alias("_low"),
        (F.shiftrightunsigned(row, 32) * sign).alias("_high"),
    )


def differing_ranges(source: DataFrame, actual: DataFrame, key: str) -> Ranges:
    """Where two tables of the same columns differ."""
    both = [df.agg(F.min(key).cast("long").alias("low"), F.max(key).cast("long").alias("high")) for df in (source, actual)]
    low, high = both[0].unionByName(both[1]).agg(F.min("low"), F.max("high")).first()
    ranges = Ranges(((low, high),) if low is not None else (), True)
    width, held = (max(1, -(-(high - low + 1) // FIRST)), high - low + 1) if low is not None else (1, 0)
    while True:
        parts = [range_sums(df.filter(ranges.holds(key)), key, low or 0, width, s) for df, s in ((source, 1), (actual, -1))]
        sums = parts[0].unionByName(parts[1]).groupBy("_range").agg(*[F.sum(c).alias(c) for c in ("_rows", "_low", "_high")])
        unlike = [r["_range"] for r in sums.filter("_rows <> 0 OR _low <> 0 OR _high <> 0").select("_range").limit(MANY + 1).collect()]
        numbers = tuple(sorted(n for n in unlike if n is not None))
        if len(unlike) > MANY or len(numbers) * width > max(MOST * held, SHORT):
            return ranges
        intervals = _joined([(low or 0) + n * width for n in numbers], width)
        spanned, held = sum(last - first + 1 for first, last in intervals), len(numbers) * width
        ranges = Ranges(intervals, None in unlike, (low, width, numbers) if spanned > held else None)
        if width <= SHORT or not numbers:
            return ranges
        width = max(1, -(-width // FANOUT))


def reconcile_ranges(source: DataFrame, fact: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """``reconcile`` of the ranges of the first key column that differ; the same rows as of the whole tables."""
    columns, types = [*key, *fields], dict(source.dtypes)
    wanted = source.select(*columns)
    actual = fact.select(*[F.col(c).cast(types[c]).alias(c) for c in columns])
    ranges = differing_ranges(wanted, actual, key[0])
    return reconcile(wanted.filter(ranges.holds(key[0])), actual.filter(ranges.holds(key[0])), key, fields)
