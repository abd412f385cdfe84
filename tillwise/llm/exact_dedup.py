"""Exact duplicates by a heavy-hitter split.

Misra-Gries summaries of every partition name the digests that may be frequent. Their exact winners are broadcast (at
most ``HEAVY`` rows) and decide frequent rows where they are; all other digests go through an ordinary shuffle, in which
no group can hold more than about ``2 / HEAVY`` of the rows.

Defined cases: a NULL text counts as empty; rows are told apart even if all their columns agree, and exactly one row of a
group stays: the smallest id, NULL ids last, any of fully equal rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.storage import stored

#: Counters of a summary, and the most rows that are ever broadcast.
HEAVY = 1024


def normalized(text: Column) -> Column:
    """White space runs as one space, NULL as empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def misra_gries(batches: Iterable[Iterable[str]], size: int) -> dict[str, int]:
    """Counters of at most ``size`` items; none is above the true count, nor below it by over ``n / (size + 1)``."""
    counters: Counter[str] = Counter()
    for batch in batches:
        counters.update(batch)
        if len(counters) > size:
            cut = sorted(counters.values(), reverse=True)[size]
            counters = Counter({item: n - cut for item, n in counters.items() if n > cut})
    return counters


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = misra_gries((b.column(0).to_pylist() for b in batches), HEAVY)
    yield pa.RecordBatch.from_pydict(
        {"digest": pa.array(list(found), pa.string()), "seen": pa.array(list(found.values()), pa.int64())}
    )


def heavy_digests(rows: DataFrame) -> DataFrame:
    """Digests whose summed counters pass ``n / (HEAVY + 1)``: at most HEAVY, and every digest of twice that share."""
    least = rows.count() / (HEAVY + 1)
    summed = rows.select("digest").mapInArrow(_summaries, "digest string, seen long")
    return summed.groupBy("digest").agg(F.sum("seen").alias("seen")).filter(F.col("seen") > least).select("digest")


def _winners(rows: DataFrame) -> DataFrame:
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    return rows.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("group_size")).select(
        "digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept`` and ``digest`` of the normalised text."""
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")
        ),
        "digests",
    )
    heavy = stored(_winners(rows.join(F.broadcast(heavy_digests(rows)), "digest", "left_semi")), "heavy")
    frequent = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    decided = frequent.unionByName(rest.join(_winners(rest), "digest"))
    return decided.select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    key, columns = "__digest", docs.columns
    keyed = docs.select(digest(F.col(text_col)).alias(key), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"))
    order = F.struct(F.col(f"__row.`{id_col}`").isNull().alias("no_id"), F.col(f"__row.`{id_col}`").alias("id"))
    slim = stored(
        keyed.select(F.col(key).alias("digest"), order.alias("id_order"), F.lit(0).alias("row")), "digests"
    )
    heavy = stored(
        slim.join(F.broadcast(heavy_digests(slim)), "digest", "left_semi")
        .groupBy(F.col("digest").alias(key))
        .agg(F.min("id_order").alias("first")),
        "heavy",
    )
    # Frequent digests: all rows but those of the smallest id go before anything moves.
    light = keyed.join(F.broadcast(heavy), key, "left").filter(F.col("first").isNull() | (F.col("first") == order))
    return light.groupBy(key).agg(F.min_by("__row", order).alias("__row")).select(
        *[F.col(f"__row.`{c}`").alias(c) for c in columns]
    )
