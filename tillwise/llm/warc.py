"""WARC archives that are written and read through an index.

Every task writes its pages as gzip members, one per record, to files of its own in the shared folder, and returns where
each record lies. That index is committed as a table; files of lost or repeated task attempts are in no index. Reading
takes index rows, sorts them by file and offset, joins neighbouring byte ranges to one read, and parses the records.

Payload digests are compared before writing: of equal payloads of at least ``min_bytes``, the one with the smallest page
id becomes a response, all others revisit it.

Defined cases: NULL html is an empty payload; a NULL url is written as an empty target; line breaks in a url are
percent-encoded in the header and come back as such; rows without a page id come last, and are responses if no equal
payload has one; rows that repeat the smallest id are responses too. Other columns are not read. An empty table gives no
archive and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.storage import scratch_path, stored

#: A task starts a new file at this size.
FILE_BYTES = 256 << 20
#: Ranges at most so far apart are read together, up to the size of a read.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20

INDEX = "page_id long, url string, digest string, record_type string, path string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_PAGES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None) -> str:
    made = uuid.uuid4() if page_id is None else uuid.uuid5(_PAGES, f"page:{page_id}")
    return f"<urn:uuid:{made}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record: the HTTP head with the payload, or the head alone for a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """A row of RECORDS."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, page = fields["WARC-Type"], fields["X-Page-ID"]
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        size = next(int(h[15:]) for h in http.decode().split("\r\n") if h.startswith("Content-Length:"))
        digest, payload = fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
    refers = fields.get("X-Refers-To-Page-ID")
    return (int(page) if page else None, size, digest, kind, int(refers) if refers else None, fields["WARC-Target-URI"], payload)


def _writer(folder: str, date: str):
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, at = None, "", 0
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for page_id, url, sha1, refers_to, payload in zip(*columns, batch.column(2).cast(pa.binary()).to_pylist()):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, path, at = store.open_output_stream(f"{root}/{name}", compression=None), name, 0
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                member = gzip.compress(record(page_id, url, payload, digest, refers_to, date), 3, mtime=0)
                out.write(member)
                kind = "response" if refers_to is None else "revisit"
                rows.append((page_id, url, digest, kind, f"{folder}/{path}", at, len(member)))
                at += len(member)
            kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)
        if out is not None:
            out.close()

    return run


def write(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives all pages and returns the committed index."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1")
    )
    large = F.octet_length("html") >= min_bytes
    groups = rows.filter(large).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = F.when(large & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))), F.col("first"))
    linked = rows.join(groups, "sha1", "left").select("page_id", "url", "html", "sha1", first.alias("refers_to"))
    folder = scratch_path(pages.sparkSession, "warc")
    return stored(linked.mapInArrow(_writer(folder, date), INDEX), "warc-index")


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of (path, offset, length), in order, that one read can fetch."""
    run: list[tuple[str, int, int]] = []
    for row in rows:
        path, offset, length = row
        if run and (path != run[-1][0] or offset - run[-1][1] - run[-1][2] > GAP_BYTES or offset + length - run[0][1] > READ_BYTES):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _reader(with_payload: bool):
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            wanted = list(zip(*(c.to_pylist() for c in batch.columns)))
            for together in _ranges(wanted):
                if together[0][0] != name:
                    name = together[0][0]
                    store, path = fs.FileSystem.from_uri(name)
                    source = store.open_input_file(path)
                start = together[0][1]
                data = source.read_at(together[-1][1] + together[-1][2] - start, start)
                found = [parsed(gzip.decompress(data[at - start : at - start + n])) for _, at, n in together]
                if not with_payload:
                    found = [(*r[:-1], None) for r in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    return run


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the given index rows (all, or any selection of them)."""
    ranges = index.select("path", "offset", "length").repartition("path").sortWithinPartitions("path", "offset")
    return ranges.mapInArrow(_reader(with_payload), RECORDS)
