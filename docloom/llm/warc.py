"""WARC archives with an index made first (operator 9).

``write_archives`` writes one gzip member per page into rolling archives and
returns the index: file, offset, length, URL, digest and kind of every record.
The index is a Parquet table that Spark commits, and archive names are unique
to a task attempt, so a lost executor leaves at most files that no index names.
Of records with equal payloads the one with the smallest id is a response; the
others revisit it and carry headers only.

``read_records`` takes any selection of the index, sorts it by file and offset,
joins neighbouring byte ranges into one read each and parses the records.  Its tasks
follow the archive bytes that the selection points to, not the size of the index.

Payloads are shuffled only if very many of them repeat: which page is the first of its
payload is found on (id, digest), and the digests that occur more than once are broadcast
up to ``MAX_BROADCAST_DIGESTS``; beyond, pages and digests are joined by a shuffle.

Archives are opened through ``pyarrow.fs`` by the URI of the shared folder
(local or mounted paths, object stores, HDFS).

Defined results: a null html is an empty payload; a null or malformed URL is
written with its control characters escaped (null: the record's own URN); a null
id sorts after all others; rows that repeat the least id of their payload are
responses all; other columns are ignored; an empty table gives empty results.  A very long
html is one record, held whole by the task that writes or reads it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.common import row_count_at_most
from docloom.session import cut_lineage, ensure_checkpoint_dir
from docloom.sources.tables import spread

ROLL_BYTES = 256 << 20  # an archive is closed once it is this long
MIN_REVISIT_BYTES = 0  # smaller payloads are always written whole
JOIN_GAP = 64 << 10  # ranges at most this far apart are read together
JOIN_BYTES = 8 << 20  # up to this many bytes at once
READ_BYTES = 64 << 20  # archive bytes of one reading task
MAX_BROADCAST_DIGESTS = 500_000  # repeated digests (about 100 bytes each)
DATE = "2024-01-01T00:00:00Z"  # capture date of pages that bring none

INDEX = (
    "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string"
)
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _escape(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _urn(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def format_record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None, digest: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP headers of its page and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: <{_urn(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_urn(page_id) if url is None else _escape(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisits:
        head[7:7] = [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of ``RECORD`` from the bytes of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != sizes[0] or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def number(urn: str | None) -> int | None:
        tail = (urn or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_bytes": sizes[0],
        "payload_digest": digest,
        "payload": payload if response else None,
    }


def write_archives(
    pages: DataFrame,
    base: str | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    roll_bytes: int = ROLL_BYTES,
    max_broadcast: int = MAX_BROADCAST_DIGESTS,
) -> DataFrame:
    """Write every page under ``base`` (a folder all executors share) and return the index."""
    base = base or f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/warc/{uuid.uuid4().hex}"
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("_same", F.sha2("payload", 256))
    repeated = rows.groupBy("_same").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    repeated = cut_lineage(repeated.select("_same", "_first"))
    if row_count_at_most(repeated, max_broadcast):
        repeated = F.broadcast(repeated)
    first = F.coalesce("_first", "page_id")  # a payload of its own is its first
    joined = spread(rows).join(repeated, "_same", "left").select("page_id", "url", "payload", first.alias("_first"))

    def write(batches):
        store, folder = fs.FileSystem.from_uri(base)
        store.create_dir(folder, recursive=True)
        task, out, name, at, made = TaskContext.get(), None, "", 0, 0
        try:
            for batch in batches:
                index = []
                for page_id, link, payload, least in zip(*(batch.column(i) for i in range(4))):
                    page_id, link, payload, least = page_id.as_py(), link.as_py(), payload.as_py(), least.as_py()
                    again = len(payload) >= min_revisit_bytes and least is not None and page_id != least
                    digest = payload_digest(payload)
                    press = zlib.compressobj(1, zlib.DEFLATED, 31)  # a gzip member for each record
                    record = format_record(page_id, link, payload, again, least, digest)
                    member = press.compress(record) + press.flush()
                    if out is None or at >= roll_bytes:
                        if out is not None:
                            out.close()
                        name = f"pages-{task.partitionId():06d}-{made:03d}-{uuid.uuid4().hex}.warc.gz"
                        out, at, made = store.open_output_stream(f"{folder}/{name}", compression=None), 0, made + 1
                    out.write(member)
                    index.append((page_id, link, name, at, len(member), digest, "revisit" if again else "response"))
                    at += len(member)
                if index:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in index], schema=arrow)
        finally:
            if out is not None:
                out.close()

    arrow = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("file", pa.string()),
            ("offset", pa.int64()),
            ("length", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
        ]
    )
    names = arrow.names
    index = cut_lineage(joined.mapInArrow(write, INDEX))
    return index.withColumn("file", F.concat(F.lit(base + "/"), F.col("file")))


def _reads(files, offsets, lengths, gap: int, most: int):
    """Runs ``(file, offset, length, members)`` of sorted ranges; members are ``(offset, length)``."""
    run = None
    for file, offset, length in zip(files, offsets, lengths):
        if run and run[0] == file and offset - run[2] <= gap and offset + length - run[1] <= most:
            run[2] = max(run[2], offset + length)
            run[3].append((offset, length))
            continue
        if run:
            yield run[0], run[1], run[2] - run[1], run[3]
        run = [file, offset, offset + length, [(offset, length)]]
    if run:
        yield run[0], run[1], run[2] - run[1], run[3]


def read_records(
    index: DataFrame, gap: int = JOIN_GAP, most: int = JOIN_BYTES, payload: bool = True, read_bytes: int = READ_BYTES
) -> DataFrame:
    """The records that the ``index`` rows (file, offset, length) point to; without
    ``payload`` its bytes are checked but not returned.  There is a task per ``read_bytes``
    of archive, and one per task slot at least."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    arrow = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("payload", pa.binary()),
        ]
    )

    def read(batches):
        opened: tuple[str, object] = ("", None)
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            for file, start, length, members in _reads(files, offsets, lengths, gap, most):
                if opened[0] != file:
                    if opened[1] is not None:
                        opened[1].close()
                    store, path = fs.FileSystem.from_uri(file)
                    opened = (file, store.open_input_file(path))
                data = opened[1].read_at(length, start)
                out = [parse_record(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in members]
                if not payload:
                    out = [{**x, "payload": None} for x in out]
                yield pa.RecordBatch.from_pylist([{n: x[n] for n in names} for x in out], schema=arrow)
        if opened[1] is not None:
            opened[1].close()

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // read_bytes))
    ranges = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(read, RECORD)
