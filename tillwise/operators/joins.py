"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of the rows, so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001
MAX_HOT_KEYS = 1000
# Items a frequency sketch tracks: its error, rows / (0.75 * items), stays far below HOT_SHARE.
_SKETCH_ITEMS = 8192
# Sketches of scan tasks are merged by this many tasks first, so that no task receives one from each scan task.
_SKETCH_GROUPS = 512
_SPREAD = 1 << 20
# Rows that a task of a dealt join makes, about, and how many tasks there are at most.
TASK_ROWS = 1 << 22
MAX_TASKS = 20_000


def known(columns: list[str]) -> Column:
    return reduce(and_, [F.col(f"`{c}`").isNotNull() for c in columns])


def fanout_left_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left outer join in which either side may repeat a key very often.

    AQE can split a hot partition of a left outer join on the left side only, of an inner join on both. So the right
    side is padded with one empty row per left key it lacks, found on the distinct keys alone, and the join becomes an
    inner one. Rows without a key stay out of the shuffle.
    """
    padded = _padded(left, right, on)
    return left.join(padded, on, "inner").unionByName(_keyless(left, right, on))


def _padded(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    keys = left.select(*on).filter(known(on)).distinct()
    missing = keys.join(right.select(*on).distinct(), on, "left_anti")
    return right.unionByName(missing.select(*on, *_nothing(right, on)))


def _keyless(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.filter(~known(on)).select("*", *_nothing(right, on))


def _nothing(right: DataFrame, on: list[str]) -> list[Column]:
    return [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns if c not in on]


def dealt_left_join(left: DataFrame, right: DataFrame, on: list[str], keys_of: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``fanout_left_join`` of few rows that make very many: tasks share the rows to be made, not those to be read.

    AQE puts partitions together by the bytes they hold, so that one task could make all pairs. ``keys_of`` are narrow
    sources of the keys of both sides, with at least as many rows as these. They tell how many rows each key makes; the left
    rows of a key that makes very many are dealt out, and its right rows go to each of their places.
    """
    rows = [keys.filter(known(on)).groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for keys, n in zip(keys_of, ("_left", "_right"))]
    made = rows[0].join(rows[1], on).withColumn("_made", F.col("_left").cast("double") * F.col("_right"))
    tasks = int((made.agg(F.sum("_made")).first()[0] or 0) // TASK_ROWS)
    if tasks < 2:
        return fanout_left_join(left, right, on)
    tasks = min(tasks, MAX_TASKS)
    pieces = F.least(F.col("_left"), F.ceil(F.col("_made") / (TASK_ROWS // 2))).cast("int").alias("_pieces")
    split = made.select(*on, pieces).filter("_pieces > 1")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    dealt = left.filter(known(on)).join(split, on, "left").withColumn("_piece", F.pmod(row, F.coalesce("_pieces", F.lit(1))).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))
    spread = _padded(left, right, on).join(split, on, "left").withColumn("_piece", copies)
    sides = [side.drop("_pieces").repartition(tasks, *on, "_piece") for side in (dealt, spread)]
    return sides[0].join(sides[1], [*on, "_piece"]).drop("_piece").unionByName(_keyless(left, right, on))


def key_hash(on: list[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in on])


def hot_keys(df: DataFrame, on: list[str], share: float = HOT_SHARE) -> DataFrame:
    """``_hash``: key hashes holding more than ``share`` of the rows of ``df`` that have a key, at most MAX_HOT_KEYS.

    A frequency sketch finds them in one scan without shuffling keys. It only decides which rows take the broadcast
    route; results do not depend on it.
    """
    state = "approx_top_k_accumulate(_hash, {0})".format(_SKETCH_ITEMS)
    partial = (
        df.filter(known(on))
        .select(key_hash(on).alias("_hash"), F.pmod(F.spark_partition_id(), F.lit(_SKETCH_GROUPS)).alias("_group"))
        .groupBy("_group")
        .agg(F.expr(state).alias("_state"), F.count(F.lit(1)).alias("_rows"))
    )
    # Grouped by a constant, because without groups an empty input would still be combined, which fails.
    top = partial.groupBy((F.col("_group") >= 0).alias("_all")).agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(_state, {_SKETCH_ITEMS}), {MAX_HOT_KEYS})").alias("_top"),
        F.sum("_rows").alias("_rows"),
    )
    return (
        top.select("_rows", F.explode("_top").alias("_item"))
        .filter(F.col("_item.count") > F.col("_rows") * share)
        .select(F.col("_item.item").alias("_hash"))
    )


def attach(left: DataFrame, right: DataFrame, on: list[str], hot_from: DataFrame | None = None) -> DataFrame:
    """Left outer join to a ``right`` that has one row per key, balanced for hot keys on the left.

    Rows of hot keys take their values from a broadcast of the matching right rows (at most MAX_HOT_KEYS of them,
    whatever the data size) and travel through the shuffle spread over extra join values that match nothing. All
    other rows join as usual. NULL keys never match and are spread the same way.

    ``hot_from`` may name a narrower source of the same key distribution, e.g. the table the keys come from.
    """
    extra = [c for c in right.columns if c not in on]
    hot = F.broadcast(hot_keys(hot_from if hot_from is not None else left.select(*on), on))
    packed = right.filter(known(on)).select(*on, F.struct(*extra).alias("_values"))
    hot_right = F.broadcast(
        packed.withColumn("_hash", key_hash(on)).join(hot, "_hash").select(*on, F.col("_values").alias("_hot"))
    )
    row = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    tagged = left.join(hot_right, on, "left").withColumn(
        "_spread", F.when(F.col("_hot").isNotNull() | ~known(on), F.pmod(row, F.lit(_SPREAD)) + 1).otherwise(F.lit(0))
    )
    # Always 0, but not a literal: the optimizer would move a literal out of the join key. The coalesce keeps it from
    # adding a NULL filter that would stop this side from sharing the shuffle of the hot side.
    cold = packed.withColumn("_spread", F.coalesce(F.pmod(F.xxhash64(*on), F.lit(1)), F.lit(0)))
    joined = tagged.join(cold, [*on, "_spread"], "left")
    values = F.coalesce("_hot", "_values")
    return joined.select(*[f"`{c}`" for c in left.columns], *[values[c].alias(c) for c in extra])
