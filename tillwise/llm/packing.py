"""Best-fit packing of tokenised documents, level by level.

Every partition packs its own pieces best-fit decreasing. Bins that are nearly full are final; underfull bins go up a
tree as items of their own, in groups of bounded size, until one group is left or a round no longer helps.

Defined cases: a NULL or empty text is the end mark alone; a document longer than a sequence is cut into full pieces and
a rest; repeated rows and NULL ids are packed like any other row. Input columns besides id and text are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.storage import stored
from tillwise.llm.word_tokens import word_ids

CAPACITY = 4096
END_ID = 1
#: A bin with at most so much room left is final.
SLACK = 8
#: Pieces packed together in one partition, and underfull bins packed together in one group.
LOCAL_PIECES, GROUP_BINS = 200_000, 20_000
#: A round must save at least this share of the underfull bins, or the tree ends.
LEAST_GAIN = 0.02

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_used long, offset long"


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and what each bin holds.

    Bins are stacked by the room they have left; a bit mask of non-empty stacks finds the tightest one.
    """
    n = len(sizes)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    used: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, size in zip(order := np.argsort(-sizes, kind="stable"), sizes[order].tolist()):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            room, chosen = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = chosen, capacity - room
        used[chosen] += size
        room -= size
        if room:
            stacks[room].append(chosen)
            mask |= 1 << room
    return bins, offsets, np.array(used, np.int64)


def _packed(path: str):
    end = END_ID.to_bytes(4, "little")
    width = 4 * CAPACITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        first_bin = TaskContext.get().partitionId() << 40
        rows: list[list] = [[], [], [], [], []]

        def packed() -> pa.RecordBatch:
            nonlocal first_bin
            doc, piece, start, length, crc = rows
            bins, offsets, used = best_fit(np.array(length, np.int64))
            columns = [doc, piece, start, length, crc, bins + first_bin, used[bins], offsets]
            first_bin += len(used)
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
            names = [c.split()[0] for c in PIECES.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            for c in rows:
                c.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                tokens = ids.text_ids(text or b"") + end
                for k, at in enumerate(range(0, len(tokens), width)):
                    part = tokens[at : at + width]
                    for c, v in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            if len(rows[0]) >= LOCAL_PIECES:
                yield packed()
        if rows[0]:
            yield packed()

    return run


def _merge_group(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("bin", ignore_index=True)
    bins, shift, used = best_fit(frame["used"].to_numpy())
    first = np.full(len(used), -1, np.int64)
    at_start = shift == 0
    first[bins[at_start]] = frame["bin"].to_numpy()[at_start]
    return pd.DataFrame({"bin": frame["bin"], "parent": first[bins], "shift": shift, "used": used[bins]})


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(source.mapInArrow(_packed(tokenizer), PIECES), "pieces")
    level = pieces.filter((F.col("offset") == 0) & (F.col("bin_used") < CAPACITY - SLACK)).select(
        "bin", F.col("bin_used").alias("used")
    )
    # moved: the sequence that an underfull bin ends up in, and where.
    moved, left = None, level.count()
    while left > 1:
        groups = -(-left // GROUP_BINS)
        merged = stored(
            level.groupBy(F.pmod(F.xxhash64("bin"), F.lit(groups)).alias("group")).applyInPandas(
                _merge_group, "bin long, parent long, shift long, used long"
            ),
            "merged",
        )
        if moved is None:
            moved = merged.select("bin", "parent", "shift")
        else:
            up = merged.select(F.col("bin").alias("parent"), F.col("parent").alias("up"), F.col("shift").alias("more"))
            moved = moved.join(up, "parent", "left").select(
                "bin",
                F.coalesce("up", "parent").alias("parent"),
                (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
            )
        level = merged.filter((F.col("bin") == F.col("parent")) & (F.col("used") < CAPACITY - SLACK)).select("bin", "used")
        before, left = left, level.count()
        if groups == 1 or before - left < LEAST_GAIN * before:
            break
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moved is None:
        return pieces.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    return pieces.join(moved, "bin", "left").select(
        *columns,
        F.coalesce("parent", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def sequence_ids(docs: DataFrame, pieces: DataFrame, tokenizer: str) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and its ``ids``; needs ids that name one document each."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = [np.frombuffer(ids.text_ids(t or b""), "<u4").tolist() + [END_ID] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokens, "doc_id long, ids array<long>")
    part = F.expr("slice(ids, CAST(start AS INT) + 1, CAST(length AS INT))")
    return (
        pieces.join(source, "doc_id")
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", part.alias("ids")))).alias("parts"))
        .select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
    )
