"""WARC archives: writing, normalising of monolithic gzip files, and reading by an offset index.

An archive that is one gzip stream can't be read from the middle. The normaliser inflates such a file once,
as a stream, writes every record again as a gzip member of its own, and emits a sidecar index with each record's
offset and length, by which readers fetch single members.

Archives are rows of a table, (archive, part, data), in Spark's shared storage: a driver's or an executor's own
folder is never used, so any store that Spark can write will do and a lost executor costs a rerun of its tasks.
Tasks roll over to a new archive after ``ARCHIVE_BYTES`` of records, which bounds the memory of every step.

Of equal payloads of at least ``REVISIT_BYTES`` bytes one is a response record, that of the smallest page id, and
the others are revisit records that name it and hold the HTTP header only. Which these are is found by
aggregating digests; the pages are joined on their ids, so a payload that very many pages share burdens no task.

Defined cases: null html is an empty payload; a null url is written as an empty target. Rows of equal id and
payload are all responses, or all revisits. A page without id never is the response of others: it is a revisit if
a page with an id has its payload. Empty tables give no archives and no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20
LEVEL = 6
GZIP = 16 + zlib.MAX_WBITS
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE = re.compile(rb"[\r\n]+")


def record_id(page: object) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}').urn}>"


def record(page: object, url: str | None, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """One WARC 1.1 record. A revisit's block is the HTTP header, which still tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: " + record_id(page).encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + _LINE.sub(b"", (url or "").encode("utf-8", "replace")),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"WARC-X-Page: " + (b"" if page is None else str(page).encode()),
    ]
    if refers_to is not None:
        head += [
            b"WARC-Profile: " + REVISIT_PROFILE.encode(),
            b"WARC-Refers-To: " + record_id(refers_to).encode(),
            b"WARC-X-Refers-To-Page: " + str(refers_to).encode(),
        ]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: " + str(len(block)).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_records(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, one after the other; only one record is held at a time."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                if not held.startswith(b"WARC/"):
                    raise ValueError("a record doesn't begin with a WARC version line")
                found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", bytes(held[: end + 2]).replace(b"\r\n", b"\n"))
                if found is None:
                    raise ValueError("a record has no Content-Length")
                need = end + 4 + int(found[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if bytes(held).strip():
        raise ValueError("the archive ends within a record")


def inflate(parts: Iterable[bytes]) -> Iterator[bytes]:
    """A gzip file's content, whether it has one member or many, in bounded pieces."""
    stream = zlib.decompressobj(GZIP)
    for part in parts:
        while part:
            piece = stream.decompress(part, 1 << 20)
            if piece:
                yield piece
            if stream.eof:
                part, stream = stream.unused_data, zlib.decompressobj(GZIP)
            else:
                part = stream.unconsumed_tail


def member(data: bytes) -> bytes:
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return deflate.compress(data) + deflate.flush()


def normalise(archive: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The archive with every record as its own member, and the (offset, length) of each."""
    out, index = bytearray(), []
    for one in split_records(inflate([archive])):
        packed = member(one)
        index.append((len(out), len(packed)))
        out += packed
    return bytes(out), index


def parse(one: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of a record."""
    head, _, rest = one.partition(b"\r\n\r\n")
    headers = dict(
        (k.strip().decode().lower(), v.strip().decode("utf-8", "replace"))
        for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])
    )
    return headers, rest[: int(headers["content-length"])]


def with_decisions(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): each page with the response that it repeats, if any."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    long = base.filter(F.length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    # one of the copies' rows each: few, and told from the others by the id, which no payload makes common
    revisits = (
        long.distinct()
        .join(first.select("digest", "refers_to"), "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
    )
    revisits = revisits.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))
    return base.join(revisits, same, "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(decided: DataFrame) -> DataFrame:
    """Archives (archive, data) of the records, each of them one gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        stream, out, size = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), [], 0

        def done() -> pa.RecordBatch:
            data = b"".join([*out, stream.flush()])
            return pa.RecordBatch.from_pydict({"archive": [f"{task:06d}-{n:05d}.warc.gz"], "data": [data]})

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                one = record(page, url, payload, digest, refers)
                out.append(stream.compress(one))
                size += len(one)
                if size >= ARCHIVE_BYTES:
                    yield done()
                    stream, out, size, n = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), [], 0, n + 1
        if size:
            yield done()

    return decided.mapInArrow(run, "archive string, data binary")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """(archive, data, index): archives with a member for each record, and their sidecar indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_type = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                out, index = normalise(data)
                listed = [[{"offset": o, "length": n} for o, n in index]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([out], pa.binary()), pa.array(listed, index_type)],
                    names=["archive", "data", "index"],
                )

    schema = "archive string, data binary, index array<struct<offset: long, length: long>>"
    return archives.select("archive", "data").mapInArrow(run, schema)


def read_records(normal: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record that the index names, from its member alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data, index in zip(batch.archive, batch.data, batch["index"]):
                rows = []
                for place in index:
                    at, length = place["offset"], place["length"]
                    headers, block = parse(zlib.decompress(data[at : at + length], GZIP))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
                    kind = headers["warc-type"]
                    told = headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, told):
                        raise ValueError(f"{name}: the payload at {at} isn't the one that was written")
                    page, refers = headers["warc-x-page"], headers.get("warc-x-refers-to-page")
                    rows.append(
                        (name, at, length, int(page) if page else None, headers["warc-target-uri"], size, told, kind)
                        + (int(refers) if refers else None, payload if payloads and kind == "response" else None)
                    )
                frame = pd.DataFrame(rows, columns=names, dtype=object)
                yield frame

    names = ["archive", "offset", "length", "page_id", "url", "payload_bytes", "payload_digest"]
    names += ["record_type", "refers_to", "payload"]
    schema = (
        "archive string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, payload binary"
    )
    return normal.mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = with_decisions(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    archives = cut(write_archives(decided), "warc")
    normal = cut(normalise_archives(archives), "warc-members")
    return read_records(normal, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
q AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM q
"""
