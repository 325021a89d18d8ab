"""WARC archives: parallel writing with an index, and reads of coalesced byte ranges.

Writing: the largest id of each payload digest is found by an aggregate (combined
before the shuffle), which decides response or revisit. Each task then writes one
archive at a time, every record a gzip member of its own, and yields an index row per
record: file, offset, length, URL, digest, type. Archive names carry a random part, so
a task that runs again never touches another's file; the index, written as Parquet, is
what makes a file count.

Reading: index rows are dealt by ranges of file and offset, as many as the archive bytes
need, and sorted; neighbours whose gap is at most `gap` bytes are fetched by one read, of
`most` bytes at most unless a record is larger. Ids, digest, type and reference come from
the records and are compared with the index.

Edge cases: a null or empty payload is a record of 0 bytes; equal payloads with the
same largest id (repeated rows) are all responses; a null id counts as smaller than
any id, and equal payloads that all have null ids are responses; a null URL is written
as an empty header; an empty table gives no archive. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm._common import prepare, shared_dir, table
from waymark.llm._files import opened, write_whole

#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 256 << 20
GAP = 64 << 10
MOST = 8 << 20
#: Archive bytes that one task reads, at most and (where there are cores for it) at least.
TASK_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
#: The record id of a null id.
NO_ID = "urn:page"
INDEX = (
    "page_id {id}, url string, file string, offset long, length long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to {id}"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: object, url: str, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One WARC record as a gzip member. A revisit has no payload; it names its response."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{NO_ID if page_id is None else f'urn:page:{page_id}'}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head.insert(3, f"WARC-Refers-To: <urn:page:{refers_to}>")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def id_of(header: str | None) -> str | None:
    """The page id of a record id."""
    return None if header is None or header == f"<{NO_ID}>" else header.removeprefix("<urn:page:").removesuffix(">")


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives and their index below `path`; returns the index."""
    spark = pages.sparkSession
    prepare(spark)
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload")
    )
    keyed = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    first = keyed.groupBy("sha").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = keyed.join(first, "sha", "left").select(
        "page_id",
        "url",
        "payload",
        F.when(F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest")).alias("refers_to"),
    )

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        rows: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal parts, rows, size
            file = f"{path}/archives/{uuid.uuid4().hex}.warc.gz"
            write_whole(file, parts)
            cols = list(zip(*rows))
            made = [
                pa.array(cols[0], ids),
                pa.array(cols[1], pa.string()),
                pa.array([file] * len(rows)),
                *(pa.array(c, pa.int64()) for c in cols[2:5]),
                pa.array(cols[5]),
                pa.array(cols[6]),
                pa.array(cols[7], ids),
            ]
            parts, rows, size = [], [], 0
            return pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            ids = batch.column("page_id").type
            for p, u, body, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                name = "response" if to is None else "revisit"
                digest = digest_of(body)
                made = record(name, p, u, body, digest, to)
                parts.append(made)
                rows.append((p, u, size, len(made), len(body), digest, name, to))
                size += len(made)
                if size >= ARCHIVE_BYTES:
                    yield close()
        if rows:
            yield close()

    told.mapInArrow(archive, INDEX.format(id=kind)).write.parquet(f"{path}/index")
    return index(spark, path)


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def fetch(records: list[tuple[str, int, int]], gap: int = GAP, most: int = MOST) -> Iterator[tuple[int, bytes]]:
    """Record number and bytes of (file, offset, length) sorted so, by coalesced reads."""
    i = 0
    while i < len(records):
        file, start, n = records[i]
        end, j = start + n, i + 1
        while j < len(records) and records[j][0] == file and records[j][1] - end <= gap and records[j][1] + records[j][2] - start <= most:
            end = max(end, records[j][1] + records[j][2])
            j += 1
        with opened(file) as f:
            f.seek(start)
            block = f.read(end - start)
        for k in range(i, j):
            at = records[k][1] - start
            yield k, block[at : at + records[k][2]]
        i = j


def read(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of index rows, read back: headers as columns, and the body.

    Rows are dealt by ranges of (file, offset), so a task reads neighbours.
    """
    spark = selected.sparkSession
    prepare(spark)
    kind = selected.schema["page_id"].dataType.simpleString()
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, ceil(size / TASK_BYTES), min(spark.sparkContext.defaultParallelism, ceil(size / LEAST_BYTES)))
    wanted = selected.select(F.col("page_id").cast("string").alias("page_id"), F.col("refers_to").cast("string").alias("refers_to"), "file", "offset", "length")
    dealt = wanted.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = list(zip(*(batch.column(c).to_pylist() for c in ("page_id", "refers_to"))))
            records = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            out: list[tuple] = []
            for i, member in fetch(records):
                head, body = parse(member)
                own = id_of(head["WARC-Record-ID"]), id_of(head.get("WARC-Refers-To"))
                if own != told[i]:
                    raise ValueError(f"the index has {told[i]} where the archive has {own}")
                if head["WARC-Type"] == "response" and digest_of(body) != head["WARC-Payload-Digest"][5:]:
                    raise ValueError(f"payload digest of {head['WARC-Record-ID']} differs")
                out.append((*own, int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][5:], head["WARC-Type"], head["WARC-Target-URI"], body if payloads else None))
            cols = list(zip(*out)) if out else [()] * 7
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
            names = ["page_id", "refers_to", "payload_bytes", "payload_digest", "record_type", "url", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    found = dealt.mapInArrow(run, "page_id string, refers_to string, payload_bytes long, payload_digest string, record_type string, url string, payload binary")
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    found = write(table(spark, sf_dir, "pages"), path)
    return read(found, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT h, max(page_id) AS newest FROM p GROUP BY h),
bits AS (
  SELECT page_id, h, i,
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1) AS c
  FROM p, range(32) AS r(i)),
d AS (SELECT page_id, h, string_agg(c, '' ORDER BY i) AS b32 FROM bits GROUP BY page_id, h)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, d.b32 AS payload_digest,
  CASE WHEN p.page_id = w.newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = w.newest THEN NULL ELSE w.newest END AS refers_to
FROM p JOIN w USING (h) JOIN d ON p.page_id = d.page_id
"""
