"""Prefix trie of conversations: one row per distinct sequence of first turns.

A conversation becomes its path: per turn the MD5 of role and text, and the bytes of the text; texts themselves never travel.
Paths are put in order, ties by conversation, and cut into shards at splitters, paths of a sample. A node that is no prefix of
a splitter has all its members in one shard, which walks its sorted paths with a stack of open nodes and finishes it. The
nodes on the splitters, the skeleton, are broadcast; shards add up their own part of each, and the parts are reduced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.storage import prepared, stored

#: Conversations of a shard, about; at most so many shards.
SHARD_ROWS, MAX_SHARDS = 50_000, 20_000
#: Sampled conversations per shard.
SAMPLED = 8
#: A splitter has at most so many turns; its size, and with it that of the skeleton, is bounded so.
SPLITTER_TURNS = 64

_PATH = "array<struct<key: binary, bytes: bigint>>"
_NONE = hashlib.sha256().hexdigest()


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``path`` of every conversation of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``).

    Turns go by ``turn``, NULL first, equal ones by role and then by the MD5 of role and text. NULL roles and texts count as
    empty. Rows without a ``conv_id`` belong to no conversation and are left out.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), role, text)))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", F.transform("t", lambda t: F.struct(t["key"], t["bytes"])).cast(_PATH).alias("path"))


def grafted(paths: DataFrame, step: int, most: int) -> DataFrame:
    """Every conversation ``c`` on the start of another: the first ``crc32(c) % most`` turns of ``c - c % step``, then its own
    turns after its first as many."""
    heads = paths.filter(F.col("conv_id") % step == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, most - 1).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    own = paths.select("conv_id", "path", (F.col("conv_id") - F.col("conv_id") % step).alias("base"), taken.alias("h"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(_PATH))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, F.slice("path", F.col("h") + 1, F.size("path"))).alias("path"))


def _splitters(paths: DataFrame) -> list[tuple]:
    """Bounds of the shards: (keys of the first turns, conversation). A path cut short, to where it leaves the sample before
    it or to ``SPLITTER_TURNS``, has no conversation and stands before all paths it starts."""
    rows = paths.count()
    fewest = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    shards = min(MAX_SHARDS, max(rows // SHARD_ROWS, min(fewest, rows // 20)), rows)
    if shards < 2:
        return []
    of = 1 << 31
    share = int(min(1.0, SAMPLED * shards / rows) * of) + 1
    start = F.transform(F.slice("path", 1, SPLITTER_TURNS + 1), lambda t: t["key"])
    drawn = paths.filter(F.pmod(F.xxhash64("conv_id"), F.lit(of)) < share).select(start.alias("keys"), "conv_id").toPandas()
    sample = sorted((tuple(bytes(k) for k in keys), int(c)) for keys, c in zip(drawn["keys"], drawn["conv_id"]))
    found = set()
    for k in range(1, shards):
        at = k * len(sample) // shards
        if at == 0 or at >= len(sample):
            continue
        (before, _), (keys, conv) = sample[at - 1], sample[at]
        if before == keys and len(keys) <= SPLITTER_TURNS:
            found.add((keys, conv))
        else:
            same = next((i for i, (a, b) in enumerate(zip(before, keys)) if a != b), min(len(before), len(keys)))
            found.add((keys[: min(same + 1, SPLITTER_TURNS)], float("-inf")))
    return sorted(found)


class _Node:
    """An open node: what is known of it so far in this shard."""

    __slots__ = ("depth", "key", "bytes", "first", "members", "children", "leaves", "saved", "ends", "n_ends", "waiting", "bone")

    def __init__(self, depth: int, key: bytes, size: int, bone: int | None) -> None:
        self.depth, self.key, self.bytes, self.bone = depth, key, size, bone
        self.first, self.members, self.children, self.leaves, self.saved, self.n_ends = None, 0, 0, 0, 0, 0
        self.ends, self.waiting = hashlib.sha256(), []

    def add(self, conv: int, ends: bool) -> None:
        self.first = conv if self.first is None else min(self.first, conv)
        self.members += 1
        if ends and self.bone is None:
            self.ends.update(f"{',' if self.n_ends else ''}{conv}".encode())
            self.n_ends += 1


def _closed(node: _Node, parent: _Node, rows: list) -> None:
    """Finish a node that lies in this shard as a whole and hand its sums to its parent; or pass on a part of the skeleton."""
    if node.bone is not None:
        rows.append((node.bone, None, node.depth, None, node.first, node.members, node.children, node.leaves, node.saved, None, node.bytes))
        return
    saved = node.saved + (node.members - 1) * node.bytes
    leaves = node.leaves or 1
    waits = (node.first, node.depth, node.members, node.children, leaves, saved, node.ends.hexdigest())
    for first, depth, members, children, below, kept, ends in node.waiting:
        rows.append((None, None, depth, node.first, first, members, children, below, kept, ends, None))
    parent.children += 1
    parent.leaves += leaves
    parent.saved += saved
    if parent.bone is None:
        parent.waiting.append(waits)
    else:
        first, depth, members, children, below, kept, ends = waits
        rows.append((None, parent.bone, depth, None, first, members, children, below, kept, ends, None))


_OUT = {
    "bone": pa.int64(), "parent_bone": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "conv_id": pa.int64(), "n_convs": pa.int64(),
    "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "bytes": pa.int64(),
}
_OUT_DDL = ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in _OUT.items())


def _walk(skeleton):
    """Nodes of shards whose rows come in order, one shard after the other; ``skeleton`` maps (parent, key) to a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bones, shard, stack, rows = skeleton.value, None, [], []

        def close(upto: int) -> None:
            while len(stack) > upto:
                node = stack.pop()
                _closed(node, stack[-1] if stack else None, rows)

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.values())], list(_OUT))

        for batch in batches:
            columns = (batch.column(name) for name in ("shard", "conv_id", "path"))
            for number, conv, path in zip(*(c.to_pylist() for c in columns)):
                if number != shard:
                    close(0)
                    shard, stack = number, [_Node(0, b"", 0, 0)]
                same = 0
                while same < len(path) and same + 1 < len(stack) and stack[same + 1].key == path[same]["key"]:
                    same += 1
                close(same + 1)
                for turn in path[same:]:
                    above = stack[-1].bone
                    bone = None if above is None else bones.get((above, turn["key"]))
                    stack.append(_Node(len(stack), turn["key"], turn["bytes"], bone))
                for node in stack:
                    node.add(conv, node.depth == len(path))
                if len(rows) > 5000:
                    yield batch_of(rows)
                    rows.clear()
        close(0)
        if rows:
            yield batch_of(rows)

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each skeleton node, which come in order, as one running sum: no list is held."""
    at, run, done = None, None, []
    for batch in batches:
        for bone, conv in zip(batch.column("bone").to_pylist(), batch.column("conv_id").to_pylist()):
            if bone != at:
                if at is not None:
                    done.append((at, run.hexdigest()))
                at, run = bone, hashlib.sha256(str(conv).encode())
            else:
                run.update(f",{conv}".encode())
    if at is not None:
        done.append((at, run.hexdigest()))
    if done:
        yield pa.record_batch([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["bone", "ends"])


def _places(splitters, skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``shard`` of each row, and ``bone``, the skeleton node at which it ends, if it ends at one."""
        cuts, bones = splitters.value, skeleton.value
        for batch in batches:
            shards, ends = [], []
            for conv, path in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist()):
                keys = tuple(t["key"] for t in path[: SPLITTER_TURNS + 1])
                shards.append(bisect_right(cuts, (keys, conv)))
                bone = 0
                for key in keys:
                    bone = bones.get((bone, key))
                    if bone is None:
                        break
                ends.append(bone if len(path) <= SPLITTER_TURNS else None)
            yield pa.record_batch([*batch.columns, pa.array(shards, pa.int32()), pa.array(ends, pa.int64())], [*batch.schema.names, "shard", "bone"])

    return run


def trie(paths: DataFrame) -> DataFrame:
    """All nodes of the trie of ``paths`` (``conv_id``, distinct; ``path``).

    ``conv_id``: smallest member; ``depth``; ``parent_conv_id``: the parent's smallest member, NULL for the root; ``n_convs``:
    members; ``n_children``; ``n_leaves`` and ``saved_tokens``: childless nodes and reused bytes in the subtree;
    ``ends_sha256``: SHA-256 of the ids of the members that end here, ascending, joined by commas. Without a conversation
    there is no node, not even a root.
    """
    spark = prepared(paths.sparkSession)
    paths = stored(paths, "paths")
    cuts = _splitters(paths)
    bones, chains = {}, [[0]]  # the skeleton: (parent, key) -> number, and the way of each number to the root, 0
    for keys, _ in cuts:
        at = 0
        for key in keys:
            if (at, key) not in bones:
                bones[at, key] = len(chains)
                chains.append([len(chains), *chains[at]])
            at = bones[at, key]
    shared, skeleton = spark.sparkContext.broadcast(cuts), spark.sparkContext.broadcast(bones)
    placed = stored(paths.mapInArrow(_places(shared, skeleton), f"conv_id long, path {_PATH}, shard int, bone long"), "placed")
    in_order = placed.drop("bone").repartition("shard").sortWithinPartitions("shard", "path", "conv_id")
    nodes = stored(in_order.mapInArrow(_walk(skeleton), _OUT_DDL), "nodes")

    # The skeleton, as large as the splitters are. Every node of it is the start of a sampled path, so it has members.
    frame = spark.createDataFrame(list(enumerate(chains)), "bone long, chain array<long>")
    parts = nodes.filter("bone IS NOT NULL").groupBy("bone").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("apart"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("bytes").alias("bytes"),
    )
    inner = frame.filter(F.size("chain") > 1).groupBy(F.col("chain")[1].alias("bone")).agg(F.count(F.lit(1)).alias("inner"))
    own = parts.join(frame, "bone").join(inner, "bone", "left").withColumn("n_children", F.col("apart") + F.coalesce("inner", F.lit(0)))
    own = stored(own.withColumn("leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long")), "skeleton")
    below = own.select(F.explode("chain").alias("bone"), "leaves", (F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    sums = below.groupBy("bone").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    enders = placed.filter("bone IS NOT NULL").select("bone", "conv_id").repartition("bone").sortWithinPartitions("bone", "conv_id")
    ends = enders.mapInArrow(_ends, "bone long, ends string")
    first = own.select(F.col("bone").alias("parent_bone"), F.col("conv_id").alias("parent_first"))
    whole = own.select("bone", "conv_id", "n_convs", "n_children", F.size("chain").cast("long").alias("size"), F.get("chain", F.lit(1)).alias("parent_bone"))
    whole = whole.join(sums, "bone").join(ends, "bone", "left").join(F.broadcast(first), "parent_bone", "left").select(
        "conv_id", (F.col("size") - 1).alias("depth"), F.col("parent_first").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256"),
    )
    apart = nodes.filter("bone IS NULL").join(F.broadcast(first), "parent_bone", "left")
    apart = apart.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_first"))
    return whole.unionByName(apart.select(whole.columns))
