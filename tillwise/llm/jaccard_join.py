"""Documents whose shingle sets are alike, by token-combination prefixes.

Equal sets are one class from the start; the join works on class representatives. A set's shingles are ordered by hash.
If two sets of ``n`` and ``m`` shingles reach the similarity ``t``, the first ``n - ceil(t n) + k`` shingles of one and the
first ``m - ceil(t m) + k`` of the other have ``k`` in common. These extended prefixes are indexed:

* sets of at most ``Alike.large`` shingles by ``k = 2``. Shingles of few sets (at most ``RARE``) are indexed one by one, frequent
  ones in combinations of two: two sets either share a rare shingle there or two frequent ones. A set with over
  ``COMBINED`` frequent shingles in its prefix would have too many combinations; it meets every other set at single
  frequent shingles, by size class.
* larger sets by ``k = d + 2``, where ``d`` is the most that they may differ in: of ``d + 2`` common shingles two have no
  differing one between them, so both sets have the combination of these neighbours. Sets near ``Alike.large`` do both.

Pairs are then cut by size, by a parity bitmap (its distance is never above the sets' difference) and by what the prefixes
differ in up to where both reach, and are verified on the full sets. Components need no pair inside one component: the
first round links each indexed set with the smallest of its bucket only, the second takes all pairs of a bucket that are
still in different components. So a group of many near copies costs pairs in proportion to its size, and no link between
different components is lost.

Defined cases: NULL or empty texts have no shingle and link with nothing; texts of fewer words than a shingle count as
one shingle; repeated rows and ids are rows of their own; NULL ids come last in the order. An empty table gives an empty
result. Shingles are compared by 63-bit hashes. Columns besides id and text are carried by ``deduplicate`` untouched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm.graph import components
from tillwise.llm.storage import discard, plain_names, stored, with_ids
from tillwise.llm.words import Batch, batches, mix

K = 2
#: A shingle in at most so many sets is indexed alone; all pairs of its sets are looked at.
RARE = 64
#: Sets with at most so many frequent shingles in their prefix meet one another at combinations of these only.
COMBINED = 8
#: Parity bitmap of a set: 1024 bits for sets of over ``LONG`` shingles, else folded to 256, with the other words zero.
LONG = 1024
BITS = [f"b{i}" for i in range(16)]


@dataclass(frozen=True)
class Alike:
    """Shingles of ``width`` words; sets are alike from ``num / den`` on. Sets of over ``large`` shingles are indexed by
    neighbours in a longer prefix."""

    width: int = 3
    num: int = 90
    den: int = 100
    large: int = 2048

    def __post_init__(self) -> None:
        if not 3 * self.den <= 4 * self.num <= 4 * self.den:
            raise ValueError("the similarity must lie between 3/4 and 1")

    def least(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def apart(self, n: int) -> int:
        """The most that a set of ``n`` and one like it may differ in."""
        return (self.den - self.num) * (n + self.den * n // self.num) // (self.den + self.num)

    def size_class(self):
        """Sizes that can be alike lie in the same class or in neighbouring ones."""
        return F.floor(F.log(F.col("n").cast("double")) / math.log(1.02 * self.den / self.num)).cast("long")


def shingle_sets(batch: Batch, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; 63 bits, so that signed order is their order."""
    words = batch.hashes()
    shingles = batch.windows(words, width)
    first = batch.first
    for d in range(len(batch)):
        lo, hi = first[d], first[d + 1]
        if hi - lo >= width:
            yield np.unique(shingles[lo : hi - width + 1] >> np.uint64(1))
        elif hi > lo:
            whole = np.uint64(hi - lo)
            for h in words[lo:hi]:
                whole = mix(np.array([whole ^ h], np.uint64))[0]
            yield np.array([whole >> np.uint64(1)], np.uint64)
        else:
            yield np.empty(0, np.uint64)


def _signature(found: np.ndarray) -> tuple[int | None, int | None]:
    if not len(found):
        return None, None
    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _bitmap(found: np.ndarray) -> list[int]:
    bits = 1024 if len(found) > LONG else 256
    odd = np.bincount((found >> np.uint64(5)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    words = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return words.tolist() + [0] * (16 - len(words))


def _neighbours(found: np.ndarray, alike: Alike) -> np.ndarray:
    """Combinations of neighbours in the prefix of a large set."""
    size = len(found)
    if alike.den * size < alike.num * alike.large:
        return np.empty(0, np.int64)
    prefix = found[: size - alike.least(size) + alike.apart(size) + 2]
    return (mix(prefix[:-1] * np.uint64(3) + prefix[1:]) >> np.uint64(1)).view(np.int64)


_LONGS = pa.list_(pa.int64())


def _describe(alike: Alike):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in source:
            for (ids, rows), batch in batches([record.column(0), record.column(1)], record.column(2), lower=True):
                n, s1, s2, prefixes, neighbours, bits = [], [], [], [], [], []
                for found in shingle_sets(batch, alike.width):
                    size = len(found)
                    n.append(size)
                    one, two = _signature(found)
                    s1.append(one)
                    s2.append(two)
                    prefixes.append(found[: size - alike.least(size) + K].view(np.int64) if alike.least(size) > K else [])
                    neighbours.append(_neighbours(found, alike))
                    bits.append(_bitmap(found))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(rows, pa.int64()),
                        *[pa.array(c, pa.int64()) for c in (n, s1, s2)],
                        pa.array(prefixes, _LONGS),
                        pa.array(neighbours, _LONGS),
                        *[pa.array(c, pa.int64()) for c in zip(*bits)],
                    ],
                    ["doc_id", "row", "n", "s1", "s2", "prefix", "neighbours", *BITS],
                )

    return run


def _full_sets(alike: Alike):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in source:
            for _, batch in batches([], record.column(0), lower=True):
                found = list(shingle_sets(batch, alike.width))
                s1, s2 = zip(*map(_signature, found))
                sets = pa.array([f.view(np.int64) for f in found], _LONGS)
                yield pa.RecordBatch.from_arrays([pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), sets], ["s1", "s2", "shingles"])

    return run


def _close(alike: Alike, a: str, b: str):
    """Sizes and bitmaps of columns under the two aliases leave the similarity possible."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = [F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in BITS]
    folded = [reduce(lambda p, q: p.bitwiseXOR(q), differ[i::4]) for i in range(4)]
    least_apart = reduce(lambda p, q: p + q, map(F.bit_count, folded))
    long_apart = reduce(lambda p, q: p + q, map(F.bit_count, differ))
    most = (alike.den - alike.num) * (x + y)
    return (
        (alike.den * F.least(x, y) >= alike.num * F.greatest(x, y))
        & ((alike.num + alike.den) * least_apart <= most)
        & ((F.least(x, y) <= LONG) | ((alike.num + alike.den) * long_apart <= most))
    )


def _candidates(reps: DataFrame, pairs: DataFrame, alike: Alike, near: bool) -> DataFrame:
    """The distinct pairs that may be alike by their bitmaps (unless they are known to be ``near`` that way) and whose
    prefixes don't differ too much already."""
    pairs = pairs.distinct()
    if not near:
        x, y = reps.select("v", "n", *BITS).alias("x"), reps.select("v", "n", *BITS).alias("y")
        joined = pairs.join(x, F.col("a") == F.col("x.v")).join(y, F.col("b") == F.col("y.v"))
        pairs = joined.filter(_close(alike, "x", "y")).select("a", "b")
    a = reps.select(F.col("v").alias("a"), F.col("n").alias("n_a"), F.col("prefix").alias("in_a"))
    b = reps.select(F.col("v").alias("b"), F.col("n").alias("n_b"), F.col("prefix").alias("in_b"))
    joined = pairs.join(a, "a").join(b, "b")
    cut = F.least(F.element_at("in_a", -1), F.element_at("in_b", -1))
    below = [F.size(F.filter(c, lambda x: x <= F.col("cut"))) for c in ("in_a", "in_b")]
    apart = below[0] + below[1] - 2 * F.size(F.array_intersect("in_a", "in_b"))
    possible = (alike.num + alike.den) * apart <= (alike.den - alike.num) * (F.col("n_a") + F.col("n_b"))
    return stored(joined.withColumn("cut", cut).filter(possible).select("a", "b"), "pairs")


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, alike: Alike) -> DataFrame:
    """The pairs (``a``, ``b``) of representatives whose full sets are alike. ``pairs`` is deleted then."""
    ends = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    need = stored(reps.join(ends, "v").select("v", "doc_id", "s1", "s2"), "need")
    texts = with_ids(docs, need, "doc_id")
    found = texts.select("text").mapInArrow(_full_sets(alike), "s1 long, s2 long, shingles array<long>")
    sets = stored(found.join(need.select("v", "s1", "s2"), ["s1", "s2"]).select("v", "shingles").dropDuplicates(["v"]), "sets")
    a = sets.select(F.col("v").alias("a"), F.col("shingles").alias("in_a"))
    b = sets.select(F.col("v").alias("b"), F.col("shingles").alias("in_b"))
    common = F.size(F.array_intersect("in_a", "in_b"))
    union = F.size("in_a") + F.size("in_b") - common
    links = stored(pairs.join(a, "a").join(b, "b").filter(alike.den * common >= alike.num * union).select("a", "b"), "links")
    discard(docs.sparkSession, need, sets, pairs)
    return links


def _links(docs: DataFrame, reps: DataFrame, alike: Alike) -> DataFrame:
    small = reps.filter(F.col("n") <= alike.large).select("v", "n", F.explode("prefix").alias("key"), F.lit(1).alias("k"))
    index = small.unionByName(reps.select("v", "n", F.explode("neighbours").alias("key"), F.lit(2).alias("k")))
    often = index.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    shared = stored(index.join(often, "key"), "shared")

    first = shared.groupBy("key").agg(F.min(F.struct("v", "n")).alias("f")).select("key", F.col("f.v").alias("b"), F.col("f.n").alias("m"))
    sizes = alike.den * F.least("n", "m") >= alike.num * F.greatest("n", "m")
    star = shared.join(first, "key").filter((F.col("v") != F.col("b")) & sizes).select(F.col("v").alias("a"), "b")
    links = _verified(docs, reps, _candidates(reps, star, alike, near=False), alike)

    labelled = shared.join(components(links), "v", "left").withColumn("c", F.coalesce("label", "v")).drop("label")
    split = labelled.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most")
    open_rows = stored(labelled.join(split.select("key"), "key", "left_semi"), "open")
    discard(docs.sparkSession, shared)
    # A pair that also meets at the key before this one has been met there: runs of common keys give one pair, not many.
    # Bitmaps are added where the rows lie by set, for one more shuffle, by key.
    before = F.lag("key").over(Window.partitionBy("v", "size").orderBy("key"))
    info = reps.select("v", *BITS)
    slim = ["key", "size", "v", "c", "n", "before"]
    alone = (F.col("df") <= RARE) | (F.col("k") == 2)
    rare = open_rows.filter(alone).withColumn("size", F.col("k").cast("long")).withColumn("before", before).select(*slim).join(info, "v")
    frequent = (
        open_rows.filter(~alone)
        .withColumn("size", F.explode(F.array(alike.size_class(), alike.size_class() + 1)))
        .withColumn("many", F.count("*").over(Window.partitionBy("v", "size")) > COMBINED)
        .withColumn("before", before)
        .select(*slim, "many")
        .join(info, "v")
    )
    few = frequent.filter(~F.col("many"))
    lists = few.groupBy("v", "size", "c", "n", *BITS).agg(F.array_sort(F.collect_list("key")).alias("all"))
    combined = (
        lists.select("*", F.posexplode("all").alias("at", "one"))
        .withColumn("two", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))))
        .withColumn("key", F.xxhash64("one", "two"))
        .withColumn("before", F.lit(None).cast("long"))
    )

    def meeting(left: DataFrame, right: DataFrame, distinct_sides: bool) -> DataFrame:
        x, y = left.alias("x"), right.alias("y")
        met = (F.col("x.key") == F.col("y.key")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.c") != F.col("y.c"))
        new = ~F.coalesce(F.col("x.before") == F.col("y.before"), F.lit(False))
        once = F.lit(True) if distinct_sides else F.col("x.v") < F.col("y.v")
        found = x.join(y, met & once & new & _close(alike, "x", "y"))
        return found.select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b"))

    many = frequent.filter("many")
    met = meeting(rare, rare, False).unionByName(meeting(combined, combined, False))
    met = met.unionByName(meeting(many, many, False)).unionByName(meeting(many, few, True))
    more = _candidates(reps, met, alike, near=True)
    discard(docs.sparkSession, open_rows)
    if more.isEmpty():
        return links
    return links.unionByName(_verified(docs, reps, more, alike))


def _classes(docs: DataFrame, alike: Alike) -> tuple[DataFrame, DataFrame]:
    """Every row with its set's class, and one row per class; ``v`` names the class."""
    source = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    schema = "doc_id long, row long, n long, s1 long, s2 long, prefix array<long>, neighbours array<long>, " + ", ".join(f"{b} long" for b in BITS)
    rows = stored(source.mapInArrow(_describe(alike), schema), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    reps = stored(
        rows.filter("n > 0")
        .groupBy("s1", "s2")
        .agg(F.min(order).alias("first"), *[F.first(c).alias(c) for c in ("n", "prefix", "neighbours", *BITS)])
        .select(F.col("first.row").alias("v"), F.col("first.doc_id").alias("doc_id"), "s1", "s2", "n", "prefix", "neighbours", *BITS),
        "reps",
    )
    slim = stored(rows.select("doc_id", "row", "n", "s1", "s2"), "rows")
    discard(docs.sparkSession, rows)  # prefixes and bitmaps of copies
    return slim, reps


def similar_documents(
    docs: DataFrame, alike: Alike = Alike(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id``, ``row``, ``n_shingles``, ``s1``, ``s2`` (the set's signature), ``v`` (its
    class), ``component_id`` (smallest id of the component) and ``stays`` (this class holds that id)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, reps = _classes(docs, alike)
    labels = components(_links(docs, reps, alike))
    ids = stored(reps.select("v", "s1", "s2", "doc_id").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v")), "ids")
    discard(docs.sparkSession, reps)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "v")
    best = ids.groupBy("label").agg(F.min(order).alias("best"))
    members = ids.join(best, "label").select(
        "s1", "s2", "v", F.col("best.doc_id").alias("component_id"), (F.col("best.v") == F.col("v")).alias("stays")
    )
    joined = rows.join(members, ["s1", "s2"], "left")
    alone = F.col("n") == 0
    return joined.select(
        "doc_id", "row", F.col("n").alias("n_shingles"), "s1", "s2", "v",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(F.col("stays")).alias("stays"),
    )


def _signed(alike: Alike, text_at: int, schema: T.StructType):
    names = [*schema.names, "s1", "s2"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in source:
            s1, s2 = [], []
            for _, batch in batches([], record.column(text_at), lower=True):
                for found in shingle_sets(batch, alike.width):
                    one, two = _signature(found)
                    s1.append(one)
                    s2.append(two)
            yield pa.RecordBatch.from_arrays([*record.columns, pa.array(s1, pa.int64()), pa.array(s2, pa.int64())], names)

    return run


def deduplicate(docs: DataFrame, alike: Alike = Alike(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id, with all its columns; texts without words all stay."""
    found = similar_documents(docs, alike, id_col, text_col)
    keep = found.filter(F.col("stays") & F.col("s1").isNotNull()).filter(F.col("row") == F.col("v")).select(
        F.col("doc_id").alias("id"), F.col("s1").alias("k1"), F.col("s2").alias("k2")
    )
    plain = plain_names(docs)
    schema = T.StructType([*plain.schema.fields, T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType())])
    signed = plain.mapInArrow(_signed(alike, docs.columns.index(text_col), plain.schema), schema)
    ident = F.col(plain.columns[docs.columns.index(id_col)]).cast("long")
    same = (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2")) & ident.eqNullSafe(F.col("id"))
    chosen = signed.join(keep, same, "left_semi").dropDuplicates(["s1", "s2"])
    return chosen.unionByName(signed.filter(F.col("s1").isNull())).select(plain.columns).toDF(*docs.columns)
