"""WARC archives: one gzip member per record, written by tasks and read by byte ranges.

Writer: each task writes its rows to files of its own in a shared folder and returns their names;
only names that a finished task returned are read, so a repeated attempt leaves no double records.
Reader: a task gets a byte range, scans it for the gzip magic, takes a candidate for a member only
if its start decodes to a WARC header, and owns the records that start inside its range; a record
may run past the range's end.  Bytes that decode to no record are passed over up to the next magic, and counted (skipped_bytes).
Files are reached by pyarrow.fs, so the folder may be local, HDFS or an object store.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import own_dir, table, written

MAGIC = b"\x1f\x8b\x08"
#: A reader has a task per range up to this many; beyond, tasks take several ranges.
MOST_TASKS = 100_000
_CHUNK = 1 << 18
_RECORD = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_SCHEMA = "path string, offset long, member_bytes long, record_type string, page_id long, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(fields: list[tuple[str, str]], block: bytes, level: int = 4) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    name = "" if page_id is None else page_id
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_RECORD}{name}>"), ("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return member(fields, http + payload)
    return member([*fields, ("WARC-Refers-To", f"<{_RECORD}{refers_to}>"), ("WARC-Profile", _PROFILE)], http)


def _writer(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        out, done = None, []
        for b in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    files.create_dir(root, recursive=True)
                    out, size, n = files.open_output_stream(f"{root}/{name}", compression=None), 0, 1
                    size += out.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                size += out.write(_page_record(page_id, url, (html or "").encode(), first, date))
                n += 1
                if size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], names=["path", "bytes", "records"])

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_payload: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 1 << 30) -> DataFrame:
    """Write a record per row of pages; returns the archives: path, bytes, records.  Page ids must be whole numbers.

    Of rows with equal payloads (html as UTF-8; null counts as empty) of at least ``least_payload``
    bytes the one with the largest id becomes a response, the others revisits of it; shorter
    payloads are all responses.  Rows that repeat the largest id are all responses; a row with a
    null id is a revisit if a row with an id has its payload.  Other columns are ignored.  An
    archive's records are those of its rows and one warcinfo.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    repeated = rows.where(F.octet_length("html") >= least_payload).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    repeated = written(repeated, "repeated")  # a side of its own: Spark can then split a frequent payload's rows
    told = rows.join(repeated, "digest", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return written(told.mapInArrow(_writer(folder, date, file_bytes), "path string, bytes long, records long"), "archives")


class _Range:
    """Bytes of a file from some position on, read in chunks as they are asked for."""

    def __init__(self, handle, at: int):
        self.handle, self.at, self.data, self.over = handle, at, bytearray(), False

    def more(self) -> bool:
        if not self.over:
            got = self.handle.read_at(_CHUNK, self.at + len(self.data))
            self.over = not got
            self.data += got
        return not self.over

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _decode(r: _Range) -> tuple[dict[str, str], bytes, int] | None:
    """Fields, block and compressed length of the member at r's start; None if none starts there."""
    z, text, fed = zlib.decompressobj(31), bytearray(), 0
    while not z.eof:
        if fed == len(r.data) and not r.more():
            return None  # cut off
        piece, fed = r.data[fed : fed + _CHUNK], min(len(r.data), fed + _CHUNK)
        try:
            text += z.decompress(piece)
        except zlib.error:
            return None
        if not b"WARC/1."[: len(text)] == text[:7]:
            return None  # after this start all is read, however long the header is
    head, found, rest = text.partition(b"\r\n\r\n")
    fields = _fields(bytes(head))
    length = fields.get("content-length", "")
    if not found or not length.isdigit() or len(rest) < int(length):
        return None
    return fields, bytes(rest[: int(length)]), fed - len(z.unused_data)


def records(handle, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, compressed length, fields and block of the records that start in [start, end)."""
    r = _Range(handle, start)
    while r.at < end:
        at = r.data.find(MAGIC)
        if at < 0:
            keep = len(MAGIC) - 1
            if len(r.data) > keep:
                r.skip(len(r.data) - keep)
            if not r.more():
                return
            continue
        r.skip(at)
        if r.at >= end:
            return
        got = _decode(r)
        if got is None:
            r.skip(1)
            continue
        yield r.at, got[2], got[0], got[1]
        r.skip(got[2])


def _page(name: str | None) -> int | None:
    name = (name or "").strip("<>").removeprefix(_RECORD)
    return int(name) if name.lstrip("-").isdigit() else None


def _row(path: str, offset: int, size: int, fields: dict[str, str], block: bytes) -> tuple:
    kind = fields.get("warc-type", "")
    payload = n = None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            payload, n = body, len(body)
            told, digest = digest, base32_sha1(body)
            if told and told != digest:
                raise ValueError(f"{path} at {offset}: the payload's digest is {digest}, not {told}")
        else:
            length = _fields(head).get("content-length", "")
            n = int(length) if length.isdigit() else None
    return path, offset, size, kind, _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), _page(fields.get("warc-refers-to")), n, digest, payload


def _reader(with_payload: bool):
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("member_bytes", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                files, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with files.open_input_file(name) as handle:
                    for offset, length, fields, block in records(handle, start, end):
                        row = _row(path, offset, length, fields, block)
                        rows.append(row if with_payload else (*row[:-1], None))
                        size += len(block) if with_payload else 0
                        if len(rows) >= 5000 or size > 32 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def read_warc(archives: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """The records of archives(path, bytes), see READ_SCHEMA; each file is cut into ranges of split_bytes.

    A response's length and digest are taken from the payload that was read (a digest that differs
    from the header's is an error), a revisit's from its headers.  An empty file has no records.
    """
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    # A count of its own: sized by the bytes of these few rows, all ranges would fall to one task.
    tasks = max(1, min(ranges.count(), MOST_TASKS))
    return ranges.repartition(tasks, "path", "start").mapInArrow(_reader(with_payload), READ_SCHEMA)


def skipped_bytes(archives: DataFrame, found: DataFrame) -> DataFrame:
    """path, skipped: the bytes of each archive that belong to no record that was read, as broken or cut-off members do."""
    counts = found.groupBy("path").agg(F.sum("member_bytes").alias("_read"))
    return archives.join(counts, "path", "left").select("path", (F.col("bytes") - F.coalesce("_read", F.lit(0))).alias("skipped"))


def all_read(archives: DataFrame, found: DataFrame) -> DataFrame:
    """found, written once, if it has as many records of each archive as were written; else an error."""
    found = written(found, "records")
    counts = found.groupBy("path").agg(F.count("*").alias("n_read"))
    short = archives.join(counts, "path", "left").where("records <> coalesce(n_read, 0)").select("path", "records", F.coalesce("n_read", F.lit(0)).alias("n_read")).take(3)
    if short:
        raise ValueError("records were lost: " + "; ".join(f"{path} has {n}, {n_read} were read" for path, n, n_read in short))
    return found


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(table(spark, sf_dir, "pages"), f"{own_dir(spark)}/warc-{uuid.uuid4().hex}")
    found = all_read(archives, read_warc(archives, with_payload=False))
    return found.where("record_type IN ('response', 'revisit')").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS last, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits FROM p GROUP BY h),
d AS (SELECT h, last, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) * [16, 8, 4, 2, 1][j + 1])) AS BIGINT), 1)), 'string_agg', '') AS digest FROM g)
SELECT page_id, strlen(h) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM p JOIN d USING (h)
"""
