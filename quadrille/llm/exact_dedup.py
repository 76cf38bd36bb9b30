"""Exact deduplication by Grace hashing.

Records go to spill files by the bits of a hash of their content, level after level, until the distinct contents
of a bucket fit an open-addressing table, in which whole contents are compared. Two passes use the same table:
the first inside each input partition, so that a group of copies is one row a partition before anything is
shuffled; the second on what all partitions kept, dealt by digest.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import fresh, quoted, read, scratch, spread_join, written

#: Bytes of distinct content that one table holds.
TABLE_BYTES = 48_000_000
#: Spill files a level, and levels that the digest's bits allow.
FANOUT, LEVELS = 16, 30


Record = tuple[bytes, bytes, list]  # digest, content, value


class OpenTable:
    """Linear probing over slots that name entries; a probe ends at an empty slot or at the same complete content."""

    def __init__(self):
        self.slots, self.mask = [-1] * 64, 63
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.values: list[list] = []
        self.bytes = 0

    def start(self, digest: bytes) -> int:
        return int.from_bytes(digest[24:], "little") & self.mask

    def find(self, digest: bytes, content: bytes) -> tuple[int, int]:
        """The slot where the probe ended, and the entry there or -1."""
        i = self.start(digest)
        while (e := self.slots[i]) >= 0:
            if self.digests[e] == digest and self.contents[e] == content:
                break
            i = (i + 1) & self.mask
        return i, e

    def put(self, slot: int, digest: bytes, content: bytes, value: list) -> None:
        self.slots[slot] = len(self.contents)
        self.digests.append(digest)
        self.contents.append(content)
        self.values.append(value)
        self.bytes += len(content) + 250
        if 2 * len(self.contents) > self.mask:
            self.mask = 2 * self.mask + 1
            self.slots = [-1] * (self.mask + 1)
            for e, other in enumerate(self.digests):
                i = self.start(other)
                while self.slots[i] >= 0:
                    i = (i + 1) & self.mask
                self.slots[i] = e

    def entries(self) -> Iterator[Record]:
        return zip(self.digests, self.contents, self.values, strict=True)


#: A spilled record: bytes of content, whether the id is there, id, rows, tied rows, digest; then the content.
HEAD = struct.Struct("<I?qqq32s")


def _spilled(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        while head := f.read(HEAD.size):
            size, has, kid, n, tied, digest = HEAD.unpack(head)
            yield digest, f.read(size), [kid if has else None, n, tied]


def _spill(f, digest: bytes, content: bytes, value: list) -> None:
    kid, n, tied = value
    f.write(HEAD.pack(len(content), kid is not None, kid or 0, n, tied, digest))
    f.write(content)


def merge(a: list, b: list) -> None:
    """[largest id, rows, rows that have it]; ids that are null count below all others."""
    if a[0] == b[0]:
        a[2] += b[2]
    elif a[0] is None or (b[0] is not None and b[0] > a[0]):
        a[0], a[2] = b[0], b[2]
    a[1] += b[1]


def grace(records: Iterable[Record], folder: str, level: int = 0, most: int = TABLE_BYTES, fanout: int = FANOUT) -> Iterator[Record]:
    """One record for each distinct content, values merged; memory is bounded by most and one content.

    A bucket whose distinct contents outgrow the table is written to fanout files by the next four bits of the
    digest, and each file is a bucket of the next level. Contents that agree in all bits used stay in one table.
    """
    table, files, paths = OpenTable(), [], []
    shift, at = 12 - 4 * level % 8, 4 * level // 8
    bucket = lambda digest: (int.from_bytes(digest[at : at + 2], "big") >> shift & 15) % fanout
    for digest, content, value in records:
        if files:
            _spill(files[bucket(digest)], digest, content, value)
            continue
        slot, entry = table.find(digest, content)
        if entry >= 0:
            merge(table.values[entry], value)
            continue
        table.put(slot, digest, content, value)
        if table.bytes > most and len(table.contents) > 1 and level < LEVELS:
            paths = [os.path.join(folder, f"{level}-{os.urandom(6).hex()}-{i}") for i in range(fanout)]
            files = [open(p, "wb") for p in paths]
            for entry in table.entries():
                _spill(files[bucket(entry[0])], *entry)
            table = OpenTable()
    if not files:
        yield from table.entries()
    for f in files:
        f.close()
    for p in paths:
        yield from grace(_spilled(p), folder, level + 1, most, fanout)
        os.remove(p)


def normalised(text: str | None) -> bytes:
    """Null is empty; A to Z become lower case and nothing else changes."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _out(records: Iterator[Record], rows: int = 2_000, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[], [], [], [], []]
    total = 0

    def batch() -> pa.RecordBatch:
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["digest", "content", "keep_id", "n", "tied"])

    for digest, content, value in records:
        for c, x in zip(cols, (digest, content, *value), strict=True):
            c.append(x)
        total += len(content)
        if len(cols[0]) >= rows or total >= size:
            yield batch()
            cols, total = [[], [], [], [], []], 0
    if cols[0]:
        yield batch()


def _local(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for b in batches:
                for kid, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    content = normalised(text.as_py())
                    yield hashlib.sha256(content).digest(), content, [kid, 1, 1]

        with scratch() as folder:
            yield from _out(grace(records(), folder, most=most))

    return run


def _global(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield row[0], row[1], list(row[2:])

        def classes() -> Iterator[Record]:
            for digest, _, value in grace(records(), folder, most=most):
                yield digest, b"", value

        with scratch() as folder:
            yield from _out(classes())

    return run


def hashed(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs and, in a further column, the SHA-256 of each row's normalised text."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [hashlib.sha256(normalised(t.as_py())).digest() for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.binary())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


CLASS = "digest binary, content binary, keep_id long, n long, tied long"


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each distinct normalised text: digest, keep_id, n rows and tied rows that have keep_id.

    Two contents of one SHA-256 are two classes of a digest; nothing stops such a run, and joins by digest would double
    their rows.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    once = rows.mapInArrow(_local(table_bytes), CLASS)
    return once.repartition(F.col("digest")).mapInArrow(_global(table_bytes), CLASS).select("digest", "keep_id", "n", "tied")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Every row's id with its group: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts. Of equal texts the largest id stays; null ids stay only where a group has no other.
    Rows that repeat both id and text are all marked kept if theirs is the id that stays (deduplicated() leaves one of
    them). An empty table gives no rows; columns other than the id and the text are not read.
    """
    members = hashed(docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text")), "text", "digest")
    told = written(classes(docs, id_col, text_col, table_bytes), "classes")
    total = int(told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    found = spread_join(members.select("doc_id", "digest"), told.select("digest", "keep_id", F.col("n").alias("rows")), "digest", F.col("doc_id"), told.select("digest", "n"), total).withColumnRenamed("rows", "n")
    return found.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the one with the largest id.

    Of rows that repeat both id and text one stays. Further columns come along whatever their names. The join is by
    digest and id, so that a large group of copies is no hot key.
    """
    digest, keep, tied = fresh(docs, "digest", "keep", "tied")
    rows = hashed(docs, text_col, digest)
    kept = classes(docs, id_col, text_col, table_bytes).select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.col("tied").alias(tied))
    stay = rows.join(kept, (rows[digest] == kept[digest]) & rows[f"`{id_col}`"].cast("long").eqNullSafe(kept[keep])).drop(kept[digest])
    once = stay.where(F.col(tied) == 1).select(*map(quoted, docs.columns))
    several = stay.where(F.col(tied) > 1).dropDuplicates([digest]).select(*map(quoted, docs.columns))
    return once.unionAll(several)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))


OP9_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
