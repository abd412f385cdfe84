"""Byte-level BPE in Spark: ranked merges are folded over the bytes of distinct words by higher-order functions.

Texts are cut into words by the tokenizer's pattern and coded block by block (``BLOCK_BYTES`` of text at most) as numbers
of the block's distinct words. Each distinct word is one row, which a fold over its byte ranks encodes: every step merges
the leftmost adjacent pair of lowest rank, looked up in a literal map from pairs of tokens to the rank of their
concatenation. The literal is split into shards, so that a lookup is an array access and a search over a few numbers. Decoding puts the byte pieces of the ids together. Words and texts stay in the task that read them: nothing is
shuffled, collected or broadcast but the vocabulary. Words of over ``FOLDED_BYTES`` bytes, for which a fold of arrays
would be quadratic, are merged with a heap in Python, by the same ranks.

Defined cases: NULL or empty texts have no ids; rows are encoded one by one, repeated or not; other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 32 << 20
FOLDED_BYTES = 128
SHARDS = 1 << 16
#: Stands for "no such pair"; above every result.
NONE = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank of the concatenation for every pair of tokens that has one."""
    found = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                found[left, right] = rank
    return found


def codes_of(ranks: dict[bytes, int]) -> dict[int, int]:
    """A scattered 16-bit code for each rank, so that ``left ^ right`` spreads pairs evenly over the shards."""
    if max(ranks.values()) >= SHARDS:
        raise ValueError(f"a vocabulary may have at most {SHARDS} tokens")
    scattered = np.random.default_rng(0).permutation(SHARDS).tolist()
    return {rank: scattered[rank] for rank in ranks.values()}


def sharded(pairs: dict[tuple[int, int], int], codes: dict[int, int]) -> list[list[int]]:
    """Shard ``left ^ right`` (codes): NONE, then right code and result by turns.

    A result is the rank, raised by one, above 16 bits of code, so results are in the order of the ranks and above all
    codes. A right code that stands at place p (from 1) has its result at index p (from 0); one that is missing has place
    0, where NONE is.
    """
    shards: list[list[int]] = [[NONE] for _ in range(SHARDS)]
    for (left, right), rank in pairs.items():
        shards[codes[left] ^ codes[right]] += [codes[right], (rank + 1 << 16) + codes[rank]]
    return shards


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Folds:
    """The literals and expressions of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        codes = codes_of(ranks)

        def literal(value: list, kind: str) -> Column:
            return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)

        self.shards = literal(sharded(pair_ranks(ranks), codes), "array<array<bigint>>")
        self.bytes = literal([codes[ranks[bytes([b])]] for b in range(256)], "array<bigint>")
        by_code, pieces = [0] * SHARDS, [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_code[codes[rank]] = rank
            pieces[rank] = token.hex()
        self.ranks, self.pieces = literal(by_code, "array<int>"), literal(pieces, "array<string>")

    def result(self, left: Column, right: Column) -> Column:
        """What two adjacent codes merge into, or NONE."""
        shard = F.get(self.shards, left.bitwiseXOR(right))
        return F.get(shard, F.array_position(shard, right))

    def ids(self, word: Column) -> Column:
        """Ids of a word given as an array of byte values."""

        def step(codes: Column, _: Column) -> Column:
            def merged(results: Column) -> Column:
                least = F.array_min(results)
                place = F.array_position(results, least).cast("int")
                both = F.slice(codes, 1, place - 1), F.array(least.bitwiseAND(F.lit(0xFFFF))), F.slice(codes, place + 2, F.size(codes))
                return F.when(least < F.lit(NONE), F.concat(*both)).otherwise(codes)

            return _let(F.zip_with(codes, F.slice(codes, 2, F.size(codes)), self.result), merged)

        start = F.transform(word, lambda b: F.get(self.bytes, b))
        folded = F.aggregate(F.slice(word, 2, F.size(word)), start, step)
        return F.transform(folded, lambda c: F.get(self.ranks, c))

    def decoded(self, ids: Column) -> Column:
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), ""))


def heap_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for long words: a heap of adjacent pairs, ordered by rank and place."""
    n = len(word)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, ends[i], ends[j]))

    for i in range(n - 1):
        offer(i)
    gone = bytearray(n)
    while heap:
        _, i, middle, end = heapq.heappop(heap)
        j = middle
        if gone[i] or ends[i] != middle or j >= n or gone[j] or ends[j] != end:
            continue
        ends[i], gone[j] = end, 1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = after[i]
    return out


CODED = "doc_id long, codes binary, word array<int>, whole binary"
_INTS = pa.list_(pa.int32())


def _coded(pattern: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        ids: list[int | None] = []
        codes: list[bytes] = []
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            words = [w.encode() for w in numbers]
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                short = [w if len(w) <= FOLDED_BYTES else b"" for w in part]
                offsets = np.concatenate([[0], np.cumsum(list(map(len, short)))]).astype(np.int32)
                values = np.frombuffer(b"".join(short), np.uint8).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                whole = pa.array([w if len(w) > FOLDED_BYTES else None for w in part], pa.binary())
                yield rows(pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary()), lists, whole)
            for at in range(0, len(ids), 2_000):
                part = codes[at : at + 2_000]
                yield rows(pa.array(ids[at : at + 2_000], pa.int64()), pa.array(part, pa.binary()), pa.nulls(len(part), _INTS), pa.nulls(len(part), pa.binary()))
            numbers.clear(), ids.clear(), codes.clear()

        def rows(*columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(columns), ["doc_id", "codes", "word", "whole"])

        for batch in source:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = find(text or "")
                ids.append(doc)
                codes.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)).tobytes())
                size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield from block()
                    size = 0
        yield from block()

    return run


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The values of the coded words one after the other."""
    counts = sizes[codes]
    shift = starts[codes] - np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(codes) else counts
    return values[np.arange(counts.sum()) + np.repeat(shift, counts)]


def _assembled(ranks_path: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: dict[bytes, int] = {}
        pieces: dict[int, bytes] = {}
        parts: list[tuple] = []
        table: list | None = None

        def long_word(word: bytes) -> tuple[list[int], bytes]:
            if not ranks:
                ranks.update(load_ranks(ranks_path))
                pieces.update({r: t for t, r in ranks.items()})
            ids = heap_ids(word, ranks)
            return ids, b"".join(pieces[i] for i in ids)

        def arrays() -> list:
            ids = [np.asarray(p[0]) for p in parts] or [np.empty(0, np.int32)]
            raw = [np.frombuffer(p[2], np.uint8) for p in parts] or [np.empty(0, np.uint8)]
            n = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
            m = np.concatenate([p[3] for p in parts]) if parts else np.empty(0, np.int64)
            return [np.concatenate(ids), np.cumsum(n) - n, n, np.concatenate(raw), np.cumsum(m) - m, m]

        for batch in source:
            is_doc = np.asarray(batch.column("codes").is_valid())
            edges = np.concatenate([[0], np.flatnonzero(np.diff(is_doc.view(np.int8))) + 1, [len(is_doc)]])
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                some = batch.slice(lo, hi - lo)
                if not is_doc[lo]:
                    if table is not None:  # words after documents: the next block
                        parts, table = [], None
                    ids, raw = some.column("ids").to_pylist(), some.column("decoded").to_pylist()
                    if some.column("whole").null_count < len(some):
                        for k, word in enumerate(some.column("whole").to_pylist()):
                            if word is not None:
                                ids[k], raw[k] = long_word(word)
                    flat = np.fromiter((i for one in ids for i in one), np.int32)
                    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                    parts.append((flat, sizes, b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))))
                    continue
                table = table or arrays()
                out, texts = [], []
                for code in some.column("codes").to_pylist():
                    numbers = np.frombuffer(code, np.uint32)
                    out.append(_gathered(table[0], table[1], table[2], numbers))
                    texts.append(_gathered(table[3], table[4], table[5], numbers).tobytes())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(out, _INTS), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (the bytes that the ids stand for) of every row."""
    folds = Folds(load_ranks(ranks_path))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    coded = source.mapInArrow(_coded(pattern), CODED)
    encoded = coded.select("doc_id", "codes", "whole", folds.ids(F.col("word")).alias("ids"))
    both = encoded.select("doc_id", "codes", "whole", "ids", folds.decoded(F.col("ids")).alias("decoded"))
    return both.mapInArrow(_assembled(ranks_path), "doc_id long, ids array<int>, decoded binary")
