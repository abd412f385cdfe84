"""Inverted index of three-letter pieces for ``like %value%`` on listings.

Per piece, the ids of the rows whose text holds it are kept as bitmaps. A search ANDs the bitmaps of the pieces of its
value, which leaves the few rows that can match; the filter itself then decides. Values without three literal characters in
a row, and rows whose text is NULL, are left to the filter alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.operators.id_bitmaps import BITS, BUCKET, is_set
from tillwise.operators.listing import COMPARISONS

GRAM = 3
#: Rows that a task cuts into pieces, about; a bucket of ids stays in one task.
TASK_ROWS = 1 << 17


def text_index(df: DataFrame, field: str, id_field: str = "id") -> DataFrame:
    """(gram, id_bucket, id_bits): all pieces of the texts of ``field``, by whole-number ids.

    Rows are dealt out by bucket before they are cut, to as many tasks as there are rows for. So pieces and bitmaps never
    travel, and what a task holds doesn't grow with the table.
    """
    ids, text = F.col(id_field).cast("long"), F.col(field).cast("string")
    rows = df.filter(ids.isNotNull() & (F.length(text) >= GRAM)).select(F.bitmap_bucket_number(ids).alias(BUCKET), F.bitmap_bit_position(ids).alias("_place"), text.alias("_text"))
    dealt = rows.repartition(max(1, rows.count() // TASK_ROWS), BUCKET)
    places = F.sequence(F.lit(1), F.length("_text") - GRAM + 1)
    pieces = F.array_distinct(F.transform(places, lambda k: F.substr("_text", k, F.lit(GRAM))))
    return dealt.select(BUCKET, "_place", F.explode(pieces).alias("gram")).groupBy("gram", BUCKET).agg(F.bitmap_construct_agg("_place").alias(BITS))


def grams_of(value: str) -> list[str]:
    """Pieces that every text matching ``%value%`` holds: those between the wildcards, an escaped character being itself."""
    parts, part = [], ""
    for escaped, wildcard, plain in re.findall(r"\\(.)|([%_])|([^\\%_])", value, re.DOTALL):
        if wildcard:
            parts.append(part)
            part = ""
        else:
            part += escaped or plain
    return sorted({p[k : k + GRAM] for p in [*parts, part] for k in range(len(p) - GRAM + 1)})


def candidates(df: DataFrame, index: DataFrame, value: str, id_field: str = "id") -> DataFrame:
    """Rows that hold all pieces of ``value``. The bitmaps of one search are at most one row per bucket of ids."""
    grams = grams_of(value)
    if not grams:
        return df
    both = index.filter(F.col("gram").isin(grams)).groupBy(BUCKET).agg(F.bitmap_and_agg(BITS).alias("_bits"), F.count(F.lit(1)).alias("_grams"))
    complete = both.filter((F.col("_grams") == len(grams)) & (F.bitmap_count("_bits") > 0)).select(F.col(BUCKET).alias("_bucket"), "_bits")
    ids = F.col(id_field).cast("long")
    found = df.withColumn("_bucket", F.bitmap_bucket_number(ids)).join(complete, "_bucket").filter(is_set(ids, F.col("_bits")))
    return found.select(*[f"`{c}`" for c in df.columns])


def like_rows(df: DataFrame, index: DataFrame, field: str, value: str, id_field: str = "id") -> DataFrame:
    """Rows with ``field like %value%``, the same as ``listing.filtered`` gives, found through the index."""
    return candidates(df, index, value, id_field).filter(COMPARISONS["like"](F.col(field), value))
