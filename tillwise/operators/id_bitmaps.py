"""Exact sets of whole-number ids as bitmaps: one row of 4 KB per 32,768 neighbouring ids.

A set can be built per load, per day or per anything, merged by OR, tested and counted, always without a shuffle of the
ids themselves: map-side each task makes its own bitmaps, and only those travel. NULL is in no set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET, BITS = "id_bucket", "id_bits"


def id_bitmaps(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(``by`` columns, ``id_bucket``, ``id_bits``): the ids of ``column``, repeated ones once."""
    ids = F.col(column).cast("long")
    known = df.filter(ids.isNotNull())
    return known.groupBy(*by, F.bitmap_bucket_number(ids).alias(BUCKET)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(ids)).alias(BITS))


def merged(bitmaps: DataFrame, *by: str) -> DataFrame:
    """One bitmap per bucket (and ``by``), of all ids that any of the rows holds."""
    return bitmaps.groupBy(*by, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))


def count_ids(bitmaps: DataFrame, alias: str) -> DataFrame:
    """Number of distinct ids in bitmaps that may overlap, as one row; 0 without any."""
    return merged(bitmaps).agg(F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0)).cast("long").alias(alias))


def is_set(ids: Column, bits: Column) -> Column:
    """Whether the bit of an id is set in the bitmap of its bucket; false without a bitmap."""
    place = F.bitmap_bit_position(ids.cast("long"))
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def not_in(df: DataFrame, column: str, bitmaps: DataFrame) -> DataFrame:
    """Rows whose id is not set in ``bitmaps`` (one row per bucket); repeats are kept, and so are rows without an id.

    A bucket meets at most 32,768 ids, so the join is balanced but for repeated ids, which AQE splits.
    """
    numbered = df.withColumn("_bucket", F.bitmap_bucket_number(F.col(column).cast("long")))
    known = bitmaps.select(F.col(BUCKET).alias("_bucket"), F.col(BITS).alias("_bits"))
    return numbered.join(known, "_bucket", "left").filter(~is_set(F.col(column), F.col("_bits"))).select(*[f"`{c}`" for c in df.columns])
