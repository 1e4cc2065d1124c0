"""WARC archives: a deduplicating writer of one gzip member a record, and a reader that splits files by byte range."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_PARTS, lookup, shared_dir, ship, slices, table, written

MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Bytes of a file after which a writer starts the next, bytes of a reader's range, and bytes read at once.
FILE_BYTES, RANGE_BYTES, CHUNK = 256 << 20, 16 << 20, 512 << 10

#: Bytes that are inflated at once, bytes over which members must follow one another from a candidate on, and tasks of a reader at most.
PIECE, CHAIN, MAX_TASKS = 16 << 10, 192 << 10, 20_000


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _clean(value: str) -> str:
    """A header value without line ends or other control characters."""
    return "".join(c if c >= " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in value)


def record(page: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One compressed record: a response with the payload, or a revisit that names the response instead."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is None:
        return _member(fields, http + payload)
    return _member([*fields, ("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Payload-Length", str(len(payload)))], http)


def first_pages(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, first): of pages with equal payloads of least_bytes at least, each later page with the one of smallest id.

    Payloads are compared by SHA-1, pre-aggregated before the shuffle, and a payload that over a
    thousandth of the pages share is resolved by a bounded broadcast.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    keyed = written(pages.where(F.col(id_col).isNotNull() & (F.length(payload) >= least_bytes)).select(F.col(id_col).alias("id"), F.sha1(payload).alias("digest")), "digests")
    by = written(keyed.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")), "payloads")
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = by.where("n > 1").select("digest", "first", (F.col("n") * HOT_PARTS > total).alias("hot"))
    return lookup(keyed, shared, "digest", "hot").where("id != first").select("id", "first")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write one record a page; returns (file, records, bytes), a row a file.

    Of pages with equal payloads the one with the smallest id is a response, the others revisit it.
    Files carry a mark of the task's attempt and are renamed when complete; the returned rows are those
    of the attempts that counted, so a repeated or speculative attempt can't disturb another's files
    (what a failed attempt leaves is in no row). A null payload or url is empty. A page with a null id is a response of its own; pages of equal id that share
    their payload are all responses or all revisits. Other columns are left out; no pages, no files.
    """
    ship(pages.sparkSession)
    later = written(first_pages(pages, id_col, payload_col, least_bytes).distinct(), "revisits")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    named = rows.where("id is not null").join(F.broadcast(later) if later.count() <= BROADCAST_ROWS else later, "id", "left")
    marked = named.unionByName(rows.where("id is null"), allowMissingColumns=True).select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("first").cast("string").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, mark, done, out, tmp, n, size = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], [], None, "", 0, 0

        def close() -> None:
            nonlocal out, n, size
            out.close()
            name = f"pages-{part:06d}-{mark}-{len(done):04d}.warc.gz"
            store.move(tmp, f"{base}/{name}")
            done.append((name, n, size))
            out, n, size = None, 0, 0

        for b in slices(batches, "payload", 8 << 20):
            for i, url, payload, first in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "first"))):
                if out is None:
                    tmp = f"{base}/_tmp-{part:06d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(tmp)
                body = (payload or "").encode()
                data = record("" if i is None else i, url or "", body, payload_digest(body), first)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["file", "records", "bytes"])

    return written(marked.mapInArrow(run, "file string, records bigint, bytes bigint"), "warc-files")


class _Window:
    """A file read forward in chunks; the bytes before the last position asked for are let go chunk by chunk."""

    def __init__(self, f: pa.NativeFile, start: int, size: int) -> None:
        self.f, self.start, self.size, self.data = f, start, size, b""

    def at(self, pos: int, n: int) -> bytes:
        """n bytes from pos on (fewer at the file's end)."""
        off, end = pos - self.start, self.start + len(self.data)
        if off + n > len(self.data) and end < self.size:
            kept = self.data[off:] if pos < end else b""
            self.f.seek(pos + len(kept))
            self.data, self.start, off = kept + self.f.read(max(CHUNK, n - len(kept))), pos, 0
        return self.data[off : off + n]


def _member_end(window: _Window, pos: int, limit: int | None = None, out: list[bytes] | None = None) -> int | None:
    """Where the gzip member at pos ends; None if the file ends first, limit if it goes on beyond it; zlib.error if there is none.

    out gets the decoded bytes if they begin as a WARC record does.
    """
    z, at, head, keep = zlib.decompressobj(31), pos, b"", out is not None
    while not z.eof:
        if limit is not None and at > limit:
            return limit
        data = window.at(at, PIECE)
        if not data:
            return None
        got = z.decompress(data)
        if keep:
            out.append(got)
            head = head + got[:7] if len(head) < 7 else head
            if len(head) >= 7 and not head.startswith(b"WARC/1."):
                out.clear()
                keep = False
        at += len(data) - len(z.unused_data)
    return at


def _begins(window: _Window, pos: int) -> bool:
    """Whether members follow one another from pos on, to the file's end or for CHAIN bytes.

    Bytes that only look like members lie in the stored blocks of a true one (an archive as a payload), which
    are 64 KB long at most, so what begins there breaks off or fails its check sum before that. Zero bytes may end the file.
    """
    at = pos
    while at < window.size and at <= pos + CHAIN:
        if window.at(at, 3) != MAGIC:
            return at > pos and not window.at(at, window.size - at).strip(b"\0") if window.size - at <= CHAIN else False
        try:
            end = _member_end(window, at, pos + CHAIN)
        except zlib.error:
            return False
        if end is None or end == pos + CHAIN:
            return True
        at = end
    return True


def _next(window: _Window, pos: int, end: int) -> int:
    """First true member start in [pos, end), or end."""
    while pos < end:
        data = window.at(pos, min(CHUNK, end + 2 - pos))
        if len(data) < 3:
            return end
        k = data.find(MAGIC)
        if k < 0:
            pos += len(data) - 2
        elif pos + k >= end:
            return end
        elif _begins(window, pos + k):
            return pos + k
        else:
            pos += k + 1
    return end


def records(f: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records that start in [start, end) of a file of gzip members.

    The first member is found by scanning for the gzip magic; a candidate counts if members follow one
    another from it on (see _begins). The next one begins where it ends. Members that are no WARC record are stepped
    over. A member that breaks off at the file's end, and a record whose header lacks a type, an id or a length that
    fits, are reported as errors, never skipped.
    """
    window = _Window(f, start, size)
    pos = _next(window, start, end)
    while pos < end:
        out: list[bytes] = []
        at = _member_end(window, pos, None, out)
        if at is None:
            raise ValueError(f"the record at {pos} breaks off")
        if out:
            head, _, rest = b"".join(out).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
            n = fields.get("Content-Length", "")
            if not n.isdigit() or len(rest) < int(n) or rest[int(n) :].strip(b"\r\n") or "WARC-Type" not in fields or "WARC-Record-ID" not in fields:
                raise ValueError(f"the record at {pos} has no type, id or length that fits")
            yield pos, fields, rest[: int(n)]
        pos = at if at >= end or window.at(at, 3) == MAGIC else _next(window, at, end)


def ranges(spark: SparkSession, folder: str, files: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, size, start, end): the byte ranges of a folder's archives, spread over tasks."""
    if files is None:
        store, base = fs.FileSystem.from_uri(folder)
        found = [(i.base_name, i.size) for i in store.get_file_info(fs.FileSelector(base)) if i.base_name.endswith(".warc.gz")]
        files = spark.createDataFrame(found, "file string, bytes bigint")
    steps = F.explode(F.expr(f"sequence(0L, bytes - 1, {range_bytes}L)"))
    cut = files.where("bytes > 0").select("file", F.col("bytes").alias("size"), steps.alias("start"))
    cut = cut.withColumn("end", F.least(F.col("start") + range_bytes, "size"))
    return cut.repartitionByRange(min(max(1, cut.count()), MAX_TASKS), "file", "start")


def read(spark: SparkSession, folder: str, files: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row a record of the archives that files names (all of the folder's without it): file, offset, type, id, url,
    digest, refers_to, payload_bytes, payload.

    Each task reads the records that start in its byte range, wherever they end. payload is the body
    after the HTTP header (null for a revisit, whose payload_bytes is that of the full payload).
    """
    ship(spark)
    names = ["file", "offset", "type", "id", "url", "digest", "refers_to", "payload_bytes", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for r in b.to_pylist():
                rows, held = [], 0
                with store.open_input_file(f"{base}/{r['file']}") as f:
                    for pos, h, block in records(f, r["size"], r["start"], r["end"]):
                        body = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                        bytes_ = len(body) if body is not None else int(h["WARC-Payload-Length"]) if "WARC-Payload-Length" in h else None
                        rows.append((r["file"], pos, h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Target-URI"), h.get("WARC-Payload-Digest"), h.get("WARC-Refers-To"), bytes_, body))
                        held += len(body or b"")
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return ranges(spark, folder, files, range_bytes).mapInArrow(run, "file string, offset bigint, type string, id string, url string, digest string, refers_to string, payload_bytes bigint, payload binary")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    files = write(table(spark, sf_dir, "pages"), folder)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("bigint")
    ship(spark)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [payload_digest(x) if x is not None else d[5:] for x, d in zip(b.column("payload").to_pylist(), b.column("digest").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "payload_bytes", "type", "refers_to")), pa.array(own, pa.string())], ["id", "payload_bytes", "type", "refers_to", "own"])

    rows = read(spark, folder, files).mapInArrow(digested, "id string, payload_bytes bigint, type string, refers_to string, own string")
    return rows.select(page("id").alias("page_id"), "payload_bytes", F.col("own").alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(b) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + list_sum(list_transform(range(0, 5), lambda j: (CASE WHEN ((('0x' || substr(h, 1 + (5 * i + j) // 4, 1))::BIGINT >> (3 - (5 * i + j) % 4)) & 1) = 1 THEN (1 << (4 - j)) ELSE 0 END)))::INT, 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""
