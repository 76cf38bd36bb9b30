"""WARC archives: a writer of one gzip member a record, and a splittable reader.

The reader's tasks own byte ranges. A task looks for gzip's magic bytes in its range, takes a place for the start of a
record only if what decompresses there begins with WARC headers, and reads to its end each record that starts inside,
past the end of the range if need be. So files of any size are read by many tasks, without an index. It reads the
archives of other writers too: WARC 1.0 and 1.1, all types of record, header names in any case.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import new_path, quoted, read, slices, spread_join, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive at which its writer begins another, and bytes of the range that a reader's task owns.
FILE_BYTES, SPLIT_BYTES = 512_000_000, 8_000_000
#: Tasks of a reader at most; beyond, a task takes several ranges.
MOST_TASKS = 100_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP headers only, whose length is that of the whole payload."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if page_id is not None:
        headers.append(("Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to, digest))]
        headers += [("Refers-To-Page-Id", str(refers_to))] if refers_to is not None else []
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _writer(folder: str, file_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        made: list[tuple[str, int, int]] = []
        out, size, n = None, 0, 0
        for batch in slices(batches, "html"):
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first", "revisit")), strict=True):
                page_id, url, html, first, revisit = (x.as_py() for x in row)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), first, revisit)
                if out is not None and size + len(data) > file_bytes:
                    out.close()
                    made.append((name, size, n))
                    out = None
                if out is None:
                    name, size, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            made.append((name, size, n))
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{m[0]}" for m in made], "bytes": pa.array([m[1] for m in made], pa.int64()), "records": pa.array([m[2] for m in made], pa.int64())})

    return run


def write_archives(pages: DataFrame, folder: str, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and return the list of archives: path, bytes, records.

    Of rows with equal payloads, by SHA-1, the one with the largest page_id is a response and the others are revisits of
    it; rows that share that page_id are all responses, and so are rows of a group without any id. Null html is an empty
    payload, a null url leaves its header out. Each task writes files of names of their own, and only those in the
    returned table count: what a lost or repeated task left is no part of the archives. An empty table gives no archive.
    """
    rows = pages.select(quoted("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    told = written(rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")), "digests")
    total = int(told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    typed = spread_join(rows, told.select("digest", "first"), "digest", F.struct("page_id", "url"), told.select("digest", "n"), total).withColumn("revisit", ~F.col("page_id").eqNullSafe(F.col("first")))
    return written(typed.select("page_id", "url", "html", "first", "revisit").mapInArrow(_writer(folder, file_bytes), "path string, bytes long, records long"), "archives")


class Range:
    """Bytes of an archive from start on; more are read when a record needs them."""

    def __init__(self, file, start: int, end: int, size: int):
        self.file, self.start, self.size = file, start, size
        self.data = bytearray(self.file.read_at(min(end + 2, size) - start, start))

    def reach(self, i: int) -> bool:
        """Have bytes beyond position i, if the archive has any."""
        while i >= len(self.data) and self.start + len(self.data) < self.size:
            at = self.start + len(self.data)
            self.data += self.file.read_at(min(1_000_000, self.size - at), at)
        return i < len(self.data)

    def member(self, i: int) -> tuple[bytes, int] | None:
        """The record that starts at position i and where it ends, or None if none does."""
        unpack, out, at = zlib.decompressobj(31), [], i
        size = 0
        try:
            while not unpack.eof:
                if not self.reach(at):
                    return None
                part = bytes(self.data[at : at + 65_536])
                out.append(unpack.decompress(part))
                at += len(part) - len(unpack.unused_data)
                if size < 7 and b"".join(out)[:7] != b"WARC/1."[: size + len(out[-1])]:
                    return None
                size += len(out[-1])
        except zlib.error:
            return None
        whole = b"".join(out)
        return (whole, at) if whole.startswith(b"WARC/1.") and b"\r\n\r\n" in whole else None


def members(file, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each record that starts at start or later and before end."""
    part, i = Range(file, start, end, size), 0
    while (i := part.data.find(MAGIC, i)) >= 0 and start + i < end:
        found = part.member(i)
        if found is None:
            i += 1
        else:
            yield start + i, found[0]
            i = found[1]


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by their names in lower case; of a name that repeats the first, and folded lines are joined."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def number(text: str | None) -> int | None:
    """A field's whole number, None where it is missing or none."""
    return int(text) if text and text.removeprefix("-").isdecimal() else None


def parsed(whole: bytes) -> dict:
    """A record's fields.

    The payload of an HTTP block, by its media type or that of a response or revisit, is what follows the HTTP headers;
    that of other records is the block. A revisit has none, and its payload_bytes are those that its HTTP headers state,
    null if they do not. A missing digest is computed from the payload, and is null for a revisit; a SHA-1 that is there
    must fit a whole payload.
    """
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = fields_of(head)
    size = number(fields.get("content-length"))
    block = rest.removesuffix(b"\r\n\r\n") if size is None else rest[:size]
    kind = fields.get("warc-type", "").lower() or None
    revisit, length, payload = kind == "revisit", len(block), block
    if kind == "revisit" or (kind in ("response", "request") and (block[:5] == b"HTTP/" or fields.get("content-type", "").lower().startswith("application/http"))):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = number(fields_of(http).get("content-length"))
        length = stated if revisit else len(payload)
        if kind == "response" and stated is not None and stated > len(payload) and "warc-truncated" not in fields:
            raise ValueError(f"payload of {fields.get('warc-record-id')} is shorter than its headers state")
    digest = fields.get("warc-payload-digest", "")
    method, _, digest = digest.rpartition(":")
    if not digest and not revisit:
        digest = base32_sha1(payload)
    elif method.lower() in ("", "sha1") and len(digest) == 32 and kind == "response" and "warc-truncated" not in fields and base32_sha1(payload) != digest.upper():
        raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
    return {
        "page_id": number(fields.get("page-id")),
        "payload_bytes": length,
        "payload_digest": digest or None,
        "record_type": kind,
        "refers_to": number(fields.get("refers-to-page-id")),
        "target_uri": fields.get("warc-target-uri", "").removeprefix("<").removesuffix(">") or None,
        "payload": None if revisit else payload,
    }


FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary, path string, at long"


def _reader(with_payload: bool) -> Callable:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for path, size, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "start", "end")), strict=True):
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as file:
                    for at, whole in members(file, start, min(end, size), size):
                        row = parsed(whole) | {"path": path, "at": at}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += 300 + len(row["payload"] or b"")
                        if held > 8_000_000:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def read_archives(archives: DataFrame, *, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the archives in a table (path, bytes): one row each, with the place where it starts.

    Each range of split_bytes is a row; ranges are dealt to as many tasks, so one large archive is read by many. Records
    of other writers have null where they lack a field, page_id above all; further columns of the table are not read.
    """
    tasks = max(1, -(-int(archives.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) // split_bytes))
    step = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(step).alias("start")).withColumn("end", F.col("start") + split_bytes)
    dealt = ranges.repartition(min(tasks, MOST_TASKS), F.col("path"), F.col("start"))
    return dealt.mapInArrow(_reader(with_payload), FIELDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(read(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id::BIGINT AS page_id, coalesce(html, '') AS payload FROM pages
), f AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS first, sha1(payload) AS hex FROM p
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
