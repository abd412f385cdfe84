"""Document fingerprints: MinHash signatures over shingles of words, and the near copies found with them.

A shingle is ``WIDTH`` words in a row (``[^\\x20\\x09-\\x0D]+``, case kept); a text with fewer words is one shingle, a text
without words has none. ``PERMUTATIONS`` universal hash functions ``a * x + b`` (modulo 2**64, ``a`` odd, so each permutes
the 64-bit shingles) are applied in numpy to all shingles of a batch; 8 bits of each hashed minimum are one place of a document's fingerprint. The
share of equal places, less the 1 in 256 that agree by chance, estimates the Jaccard similarity of two documents.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tillwise.llm.graph import components
from tillwise.llm.storage import discard, prepared, stored, with_ids
from tillwise.llm.words import BATCH_BYTES, Batch, mix

WIDTH = 5
#: 25 bands of 5 places: documents alike to 0.8 share a band with a probability of 0.9999, to 0.5 with 0.55, to 0.3 with 0.06.
BANDS, PLACES = 25, 5
PERMUTATIONS = BANDS * PLACES
#: How often the documents of a band meet its smallest: by single bands, then by pairs of bands. It only saves pairs: what
#: is still in different classes of a band then meets in full.
ROUNDS = 3
#: Bands of more documents are dealt out to pairs of parts of about so many.
PART = 1024
#: Pairs from this Jaccard similarity on are near copies.
LEAST = 0.8
#: Pairs whose fingerprints say less than four standard errors below ``LEAST`` are not verified.
LEAST_LIKENESS = LEAST - 4 * (LEAST * (1 - LEAST) / PERMUTATIONS) ** 0.5
#: Documents are put in order in blocks of about so many rows, at most ``MAX_BLOCKS``; a block is streamed, never held.
BLOCK_ROWS, MAX_BLOCKS = 20_000, 100_000
#: Ids looked at per block to find its bounds. They only decide where blocks end.
SAMPLED = 8

_seeds = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = _seeds[0::2] | np.uint64(1), _seeds[1::2]


def shingles(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in order, repeats included, and the number of each text's."""
    hashes, counts = batch.hashes(), np.diff(batch.first)
    wide = batch.windows(hashes, WIDTH)
    many = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
    place = np.repeat(batch.first[:-1] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    found = wide[place]
    for width in range(1, WIDTH):
        short = np.flatnonzero(counts == width)
        if len(short):
            found[(np.cumsum(many) - many)[short]] = batch.windows(hashes, width)[batch.first[:-1][short]]
    return found, many


def signatures(texts: list[bytes]) -> np.ndarray:
    """One row of ``PERMUTATIONS`` bytes per text; all are 255 where there is no word."""
    found, many = shingles(Batch(texts))
    out = np.full((len(texts), PERMUTATIONS), 0xFF, np.uint8)
    some = np.flatnonzero(many)
    if len(some):
        starts, value = (np.cumsum(many) - many)[some], np.empty_like(found)
        for k in range(PERMUTATIONS):
            np.multiply(found, _A[k], out=value)
            value += _B[k]
            out[some, k] = mix(np.minimum.reduceat(value, starts)).astype(np.uint8)  # minima are small, mixed ones are not
    return out


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(((a == b).mean(1) - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def _bounds(docs: DataFrame, id_col: str) -> list:
    """Smallest ids of all blocks but the first, in order; ids that occur. At most ``SAMPLED * MAX_BLOCKS`` are looked at."""
    rows = docs.count()
    blocks = min(MAX_BLOCKS, max(1, rows // BLOCK_ROWS, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2, rows // 100)))
    share = min(1.0, SAMPLED * blocks / max(rows, 1))
    of = 1 << 31
    some = docs.select(F.col(f"`{id_col}`").alias("id")).filter((F.pmod(F.xxhash64("id"), F.lit(of)) < int(share * of) + 1) & F.col("id").isNotNull())
    ids = sorted(r["id"] for r in some.distinct().collect())
    return sorted({ids[k * len(ids) // blocks] for k in range(1, blocks)}) if ids else []


_ROW = ["block", "tail", "id", "packed"]


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``block``, ``tail``, ``id`` and ``packed``: every document in the order of ids within its block, and behind each block,
    as ``tail``, the first document of the next one (behind the last, the first of all). Texts travel once, compressed."""
    spark, bounds = docs.sparkSession, _bounds(docs, id_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    first = rows.select(F.min(F.struct("id"))["id"].alias("id")).first()["id"]
    last, shared = len(bounds), spark.sparkContext.broadcast(bounds)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, packer = shared.value, zstandard.ZstdCompressor()
        for batch in batches:
            take, block, tail = [], [], []
            for k, x in enumerate(batch.column("id").to_pylist()):
                at = 0 if x is None else bisect_right(cuts, x)
                opens = x == first or (x is not None and at > 0 and cuts[at - 1] == x)
                for copy in range(2 if opens else 1):
                    take.append(k)
                    block.append(((at or last + 1) - 1) if copy else at)
                    tail.append(copy)
            packed = [packer.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = [pa.array(block, pa.int32()), pa.array(tail, pa.int32())]
            columns += [batch.column("id").take(pa.array(take)), batch.column("h").take(pa.array(take)), pa.array([packed[k] for k in take], pa.binary())]
            yield pa.record_batch(columns, ["block", "tail", "id", "h", "packed"])

    schema = T.StructType().add("block", "integer").add("tail", "integer").add("id", rows.schema["id"].dataType).add("h", "long").add("packed", "binary")
    dealt = rows.withColumn("h", F.xxhash64("text")).mapInArrow(placed, schema).repartition("block")
    return dealt.sortWithinPartitions("block", "tail", F.asc_nulls_first("id"), "h", "packed").select(*_ROW)


def _stream(rows: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows with their texts, in lists whose texts are small, or that hold a single row."""
    packer = zstandard.ZstdDecompressor()
    for batch in rows:
        part, size = [], 0
        for block, tail, ident, packed in zip(*(batch.column(name).to_pylist() for name in _ROW)):
            text = packer.decompress(packed)
            if part and size + len(text) > BATCH_BYTES:
                yield part
                part, size = [], 0
            part.append((block, tail, ident, text.decode()))
            size += len(text)
        if part:
            yield part


def _fingerprints(kind: pa.DataType):
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [kind, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last row of the list before and its signature
        for part in _stream(batches):
            marks = signatures([row[3].encode() for row in part])
            rows = ([before[0]] if before else []) + part
            marks = np.vstack([before[1], marks]) if before else marks
            before = rows[-1], marks[-1:]
            kept, texts = [], []
            for k, ((block, tail, _, text), after) in enumerate(zip(rows, rows[1:])):
                if tail == 0 and after[0] == block:
                    cut = len(text) // 4
                    kept.append(k)
                    texts.append((text[: len(text) - cut] + after[3][:cut]).encode())
            if kept:
                own, edited = marks[kept], signatures(texts)
                columns = [
                    [rows[k][2] for k in kept], [len(rows[k][3]) for k in kept], [hashlib.sha256(t).hexdigest() for t in texts],
                    [s.tobytes() for s in own], [s.tobytes() for s in edited], _likeness(own, edited), _likeness(own, marks[[k + 1 for k in kept]]),
                ]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_chars``, ``fingerprint``, and the fingerprint of the text with its end replaced, per document.

    ``edited_…`` is about the text whose last quarter of code points (rounded down) is replaced by the first as many (or all)
    of the next document's, ids ascending, NULL first, then by the texts' hashes; behind the last comes the first.
    ``near_edited`` and ``near_next`` are the likenesses to the edited text and to the next document, 0 to 1. NULL texts
    count as empty; two texts without words are alike to 1, one and a text with words to 0. Repeated rows each count; a
    single document is its own next one. An empty table gives no rows.
    """
    prepared(docs.sparkSession)
    kind = docs.select(F.col(f"`{id_col}`").alias("id")).schema[0].dataType
    schema = T.StructType([T.StructField("id", kind)]).add("n_chars", "long")
    schema = schema.add("edited_sha256", "string").add("fingerprint", "binary").add("edited_fingerprint", "binary")
    schema = schema.add("near_edited", "double").add("near_next", "double")
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    return _ordered(docs, id_col, text_col).mapInArrow(_fingerprints(to_arrow_type(kind)), schema)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Estimated Jaccard similarity from two fingerprints."""
    if not len(a):
        return pd.Series([], dtype=float)
    return pd.Series(_likeness(*(np.frombuffer(b"".join(s), np.uint8).reshape(-1, PERMUTATIONS) for s in (a, b))))


def _overlap(x: np.ndarray, y: np.ndarray) -> float:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(1, len(x) + len(y) - common)


@F.pandas_udf(T.DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_overlap(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(a, b)], dtype=float)


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ident, text in zip(batch.column("rep").to_pylist(), batch.column("text").to_pylist()):
            found, _ = shingles(Batch([(text or "").encode()]))
            yield pa.record_batch([pa.array([ident], pa.int64()), pa.array([np.unique(found.astype(np.uint32)).tobytes()], pa.binary())], ["rep", "shingles"])


def _with_leads(rows: DataFrame) -> DataFrame:
    """``rep``, ``band`` and ``lead``, the smallest of the band, where a band has more than one."""
    leads = rows.groupBy("band").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "lead")
    return with_ids(rows, leads, "band").join(leads, "band")


def _pairs_of_bands(rows: DataFrame) -> DataFrame:
    """Every two of a document's bands as one; near copies share two bands with a probability of 0.9994."""
    bands = rows.groupBy("rep").agg(F.sort_array(F.collect_set("band")).alias("bands"))  # at most BANDS
    two = F.flatten(F.transform("bands", lambda x, i: F.transform(F.slice("bands", i + 2, F.lit(BANDS)), lambda y: F.xxhash64(x, y))))
    return bands.select("rep", F.explode(two).alias("band"))


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rep`` and ``shingles`` of the documents whose id is a ``rep`` of ``wanted``."""
    texts = docs.select(F.col(f"`{id_col}`").alias("rep"), F.col(f"`{text_col}`").alias("text"))
    return with_ids(texts, wanted, "rep").mapInArrow(_shingle_sets, "rep long, shingles binary")


def _verified(docs: DataFrame, close: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose shingles are alike to ``LEAST``."""

    def sets(side: str) -> DataFrame:
        found = _sets(docs, close.select(F.col(side).alias("rep")), id_col, text_col)
        return found.select(F.col("rep").alias(side), F.col("shingles").alias(f"s{side}"))

    both = close.join(sets("b"), "b").join(sets("a"), "a")
    return stored(both.filter(_jaccard("sa", "sb") >= LEAST).select("a", "b").distinct(), "links")


_MEMBER = ["band", "low", "high", "number", "rep", "c", "part", "fingerprint"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal ``band``, ``low`` and ``high``, which follow one another, as a table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in _MEMBER[:3])))
        edges = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
        for start, end in zip(edges, [*edges[1:], len(keys)]):
            if held and keys[start] != last:
                yield pa.Table.from_batches(held)
                held.clear()
            held.append(batch.slice(start, end - start))
            last = keys[start]
    if held:
        yield pa.Table.from_batches(held)


def _alike(group: pa.Table, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a group, and those behind each that are of another class, first meet in this band and have fingerprints alike
    enough. ``label`` may change meanwhile."""
    low, high, number = (group.column(c)[0].as_py() for c in ("low", "high", "number"))
    part, n = group.column("part").to_numpy(), len(group)
    prints = np.frombuffer(b"".join(group.column("fingerprint").to_pylist()), np.uint8).reshape(n, PERMUTATIONS)
    bands = prints.reshape(n, BANDS, PLACES)[:, :number]
    for k in range(n) if low == high else np.flatnonzero(part == low):
        others = np.arange(k + 1, n) if low == high else np.flatnonzero(part == high)
        others = others[label[others] != label[k]]
        others = others[_likeness(prints[others], prints[k]) >= LEAST_LIKENESS] if len(others) else others
        others = others[~(bands[others] == bands[k]).all(2).any(1)] if len(others) else others
        if len(others):
            yield int(k), others


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each group that are alike to another one of it."""
    for group in _groups(batches):
        met = np.zeros(len(group), bool)
        for k, others in _alike(group, group.column("c").to_numpy()):
            met[k] = met[others] = True
        if met.any():
            yield from group.filter(pa.array(met)).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the rows of each group; none between rows that others of the group connect already."""
    for group in _groups(batches):
        label, rep, a, b = group.column("c").to_numpy().copy(), group.column("rep").to_numpy(), [], []
        sets = [np.frombuffer(s, np.uint32) for s in group.column("shingles").to_pylist()]
        for k, others in _alike(group, label):
            for other in others:
                if label[other] != label[k] and _overlap(sets[k], sets[other]) >= LEAST:
                    label[label == label[other]] = label[k]
                    a.append(min(rep[k], rep[other]))
                    b.append(max(rep[k], rep[other]))
        if a:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _apart(docs: DataFrame, rows: DataFrame, reps: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (``a``, ``b``) between classes, of all pairs of a band that are in different classes yet.

    No task holds a band: one of many documents is dealt out to parts, and each two parts meet on their own. Only
    documents with a fingerprint alike to another one's bring their shingles, and pairs are never written."""
    named = rows.join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("c", F.coalesce("label", "rep")).drop("label")
    split = named.groupBy("band").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    open_rows = stored(named.join(split.filter("least < most").select("band", "parts"), "band"), "apart")
    prints = with_ids(reps.select("rep", "fingerprint"), open_rows, "rep")
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    dealt = open_rows.join(prints, "rep").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).select(*_MEMBER)

    def met(members: DataFrame) -> DataFrame:
        return members.repartition(*_MEMBER[:3]).sortWithinPartitions(*_MEMBER[:3])

    live = stored(met(dealt).mapInArrow(_live, dealt.schema), "live")
    sets = _sets(docs, live.select("rep"), id_col, text_col)
    links = stored(met(live.join(sets, "rep").select(*_MEMBER, "shingles")).mapInArrow(_linked, "a long, b long"), "links")
    discard(docs.sparkSession, open_rows, live)
    return links


def near_copies(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``class_id`` for the documents of ``marks`` (``id``: long, ``fingerprint``) that have a near copy.

    Documents of one fingerprint count as one. In every band, the documents with equal places meet the one with the smallest
    id, so a band of copies gives as many pairs as rows. Those that the verification keeps apart from it meet once more where
    they share two bands, again the smallest one, and what stays apart there once again. Then every two documents of a band
    that no links connect yet are compared, so each pair that shares a band is looked at or connected. A pair is a link when the Jaccard similarity of the texts' 64-bit shingle hashes is
    at least ``LEAST``; classes are the connected groups, named by their smallest id. Texts without words and rows without
    an id have no copies.
    """
    spark = prepared(docs.sparkSession)
    none = F.lit(b"\xff" * PERMUTATIONS)
    marks = marks.select("id", "fingerprint").filter((F.col("fingerprint") != none) & F.col("id").isNotNull())
    reps = stored(marks.groupBy("fingerprint").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substr("fingerprint", k * PLACES + 1, F.lit(PLACES))))
    rows = reps.select("rep", F.posexplode(band).alias("number", "band"))
    links, used = [], [reps]
    for number in range(ROUNDS):
        met = stored(_with_leads(rows), "bands")
        used.append(met)
        if met.isEmpty():
            break
        every = met if number == 0 else every
        pairs = met.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
        prints = [with_ids(reps, met.select(F.col(c).alias("rep")), "rep") for c in ("lead", "rep")]
        prints = [p.select(F.col("rep").alias(c), F.col("fingerprint").alias(f"f{c}")) for p, c in zip(prints, "ab")]
        close = pairs.join(prints[1], "b").join(prints[0], "a").filter(likeness("fa", "fb") >= LEAST_LIKENESS).select("a", "b")
        close = stored(close, "candidates")
        links.append(_verified(docs, close, id_col, text_col))
        used += [close, links[-1]]
        linked = links[-1].select(F.col("a").alias("lead"), F.col("b").alias("rep"))
        rows = met.filter("rep <> lead").join(linked, ["lead", "rep"], "left_anti").select("rep", "band")
        rows = _pairs_of_bands(rows) if number == 0 else rows
    found = reduce(DataFrame.unionByName, links) if links else None
    if found is not None:
        labels = components(found)
        used.append(_apart(docs, every.filter("rep <> lead").drop("lead"), reps, labels, id_col, text_col))
        labels = labels if used[-1].isEmpty() else components(found.unionByName(used[-1]))
    same = reps.filter("copies > 1").select("rep", F.col("rep").alias("class_id"))
    if found is not None:
        merged = labels.select(F.col("v").alias("rep"), F.col("label").alias("class_id"))
        same = merged.unionByName(same.join(merged, "rep", "left_anti"))
    classes = with_ids(reps, same, "rep").join(same, "rep").select("fingerprint", "class_id")
    copies = stored(marks.join(classes, "fingerprint").groupBy("id").agg(F.min("class_id").alias("class_id")), "copies")
    discard(spark, *used)
    return copies
