"""Slowly changing dimensions without MERGE: one full outer join per load."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.schemas import FIRST_DAY, OPEN_END


def require_unique(df: DataFrame, on: list[str]) -> DataFrame:
    """Pass ``df`` through; the job fails when a key occurs twice.

    The window needs the same partitioning and order as the merge join after it, so it costs no shuffle of its own.
    """
    repeats = F.count(F.lit(1)).over(Window.partitionBy(*on))
    return (
        df.withColumn("_repeats", repeats)
        .filter(F.assert_true(F.col("_repeats") < 2, f"key ({', '.join(on)}) is not unique in stage").isNull())
        .drop("_repeats")
    )


def differs(left: str, right: str, columns: list[str]) -> Column:
    """True when any of the columns differs, NULL being an ordinary value."""
    return reduce(or_, [~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def scd2_step(
    stage: DataFrame,
    current: DataFrame,
    bk: list[str],
    tracked: list[str],
    key: str,
    as_of: dt.date,
    carried: list[str] = (),
    since: str | None = None,
    initial_from: dt.date = FIRST_DAY,
) -> DataFrame:
    """Rows of the next run of a type-2 dimension: kept, closed, reopened and new ones.

    ``current`` holds the open rows. A changed row is closed at ``as_of - 1`` and reopened at ``as_of``; a new row
    starts at the day of its ``since`` column or, without one, at ``initial_from``. Rows missing from stage stay open.
    ``carried`` columns are stored but a change in them alone opens no version. Rows that need a key have a NULL
    ``key``; see ``with_new_keys``. Two changes on one day leave a row with ``valid_to < valid_from``.
    """
    values = [*tracked, *carried]
    start = F.coalesce(F.to_date(F.col(since)), F.lit(initial_from)) if since else F.lit(initial_from)
    types = {f.name: f.dataType for f in current.schema.fields}
    incoming = require_unique(
        stage.select(
            *[F.col(c).cast(types[c]).alias(c) for c in [*bk, *values]], start.cast("date").alias("_start")
        ),
        bk,
    ).select(*bk, F.struct(*values, F.col("_start").alias("valid_from")).alias("new"))
    existing = current.select(*bk, F.struct(key, *values, "valid_from", "valid_to").alias("old"))

    def row(source: str, row_key: Column, valid_from: Column, valid_to: Column) -> Column:
        return F.struct(
            row_key.cast("long").alias(key),
            *[F.col(f"{source}.{c}").alias(c) for c in values],
            valid_from.cast("date").alias("valid_from"),
            valid_to.cast("date").alias("valid_to"),
        )

    no_key, open_end = F.lit(None), F.lit(OPEN_END)
    kept = row("old", F.col(f"old.{key}"), F.col("old.valid_from"), F.col("old.valid_to"))
    closed = row("old", F.col(f"old.{key}"), F.col("old.valid_from"), F.date_sub(F.lit(as_of), 1))
    reopened = row("new", no_key, F.lit(as_of), open_end)
    added = row("new", no_key, F.col("new.valid_from"), open_end)
    outcome = (
        F.when(F.col("old").isNull(), F.array(added))
        .when(F.col("new").isNotNull() & differs("new", "old", tracked), F.array(closed, reopened))
        .otherwise(F.array(kept))
    )
    rows = incoming.join(existing, bk, "full").select(*bk, F.explode(outcome).alias("_row")).select(*bk, "_row.*")
    return rows.select(*current.columns)


def scd2_merge(
    stage: DataFrame, dim: DataFrame, bk: list[str], tracked: list[str], key: str, as_of: dt.date, **options
) -> DataFrame:
    """The whole dimension after the load: earlier history plus the rows of ``scd2_step``."""
    is_open = F.col("valid_to") == F.lit(OPEN_END)
    history = dim.filter(~is_open)
    return history.unionByName(scd2_step(stage, dim.filter(is_open), bk, tracked, key, as_of, **options))


def scd1_upsert(stage: DataFrame, dim: DataFrame, bk: list[str], columns: list[str], key: str) -> DataFrame:
    """Matched rows take the stage values and keep their key, new rows get a NULL key, other rows stay."""
    types = {f.name: f.dataType for f in dim.schema.fields}
    incoming = require_unique(stage.select(*[F.col(c).cast(types[c]).alias(c) for c in [*bk, *columns]]), bk)
    incoming = incoming.select(*bk, F.struct(*columns).alias("new"))
    existing = dim.select(*bk, key, F.struct(*columns).alias("old"))
    merged = incoming.join(existing, bk, "full")
    values = F.coalesce("new", "old")
    return merged.select(*bk, key, *[values[c].alias(c) for c in columns]).select(*dim.columns)


def with_new_keys(df: DataFrame, key: str, highest: int) -> DataFrame:
    """Fill missing surrogate keys above ``highest``: unique, not contiguous, no global sort.

    Call it last before the write, so that a retried write task numbers its own rows afresh and nothing else.
    """
    fresh = F.monotonically_increasing_id() + F.lit(highest + 1)
    filled = F.coalesce(F.col(key), fresh) if key in df.columns else fresh
    return df.withColumn(key, filled)
