"""What the training-data operators share: inputs, samples, memo tables and spill files."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.sources.shared import drop_written, new_path, written

__all__ = ["Memo", "WORD", "check_new", "drop_written", "fresh", "hash_sample", "held_out", "new_path", "partitions", "quoted", "read", "scratch", "slices", "spread_join", "training_ids", "training_rows", "written"]

#: ASCII white space: space and U+0009 to U+000D. Words are runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test-data layout, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(frame: DataFrame | list[str], *bases: str) -> list[str]:
    """Column names that clash with none in the frame, or in a list of names, whatever their case."""
    taken = {c.lower() for c in (frame if isinstance(frame, list) else frame.columns)}
    out = []
    for base in bases:
        name = f"_{base}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def check_new(frame: DataFrame, *names: str | None) -> None:
    """An error if a column of one of the names, whatever their case, is there already; None is no name."""
    there = {c.lower() for c in frame.columns}
    if clash := [n for n in names if n and n.lower() in there]:
        raise ValueError(f"columns that are there already: {', '.join(clash)}")


def quoted(name: str) -> Column:
    """A top-level column whose name may hold dots."""
    return F.col(f"`{name}`")


def partitions(frame: DataFrame, floor: int = 1) -> int:
    """The number of partitions asked for by the session, at least floor."""
    return max(floor, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hash_sample(frame: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most rows rows, the first by a hash of the keys: the same at every run.

    A cut of the hash range, from the number of rows, leaves about twice the rows wanted before anything is sorted, so
    what meets in one task does not grow with the table.
    """
    total = frame.count()
    if total > 2 * rows:
        frame = frame.where(F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < int(2_000_000 * rows / total) + 1)
    return frame.orderBy(F.xxhash64(*keys), *keys).limit(rows)


def training_ids(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most rows labelled doc_ids outside the held-out fold, half of each label at most: doc_id, y.

    Held out are the rows whose crc32 of the doc_id as text is 2 modulo 4. The bound rows is the documented size of
    the sample that the classifiers are fitted on; scoring covers every row.
    """
    told = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    return hash_sample(told.where("y = 1"), rows // 2, "doc_id").unionAll(hash_sample(told.where("y = 0"), rows // 2, "doc_id"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, stated: str | None = None) -> tuple[list[str], list[int], list[int | None]]:
    """The texts and labels of training_ids(), and a whole-number column of theirs, on the driver: bounded by rows, ordered by doc_id."""
    ids = training_ids(labels, label, rows)
    told = F.col(stated).cast("long") if stated else F.lit(None).cast("long")
    got = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.coalesce("text", F.lit("")).alias("text"), told.alias("stated")).alias("row"))
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("row").alias("row"))
        .select("doc_id", "y", "row.text", "row.stated")
        .toPandas()
        .sort_values("doc_id", kind="stable")
    )
    return list(got["text"]), [int(y) for y in got["y"]], [None if n != n or n is None else int(n) for n in got["stated"]]


def held_out() -> Column:
    """True for the fold that no classifier learns labels from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


#: Keys that are spread over tasks at most: those of more than one in so many of all rows, and of more than HOT_LEAST.
HOT_KEYS, HOT_LEAST = 1_000, 100


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: Column, counts: DataFrame, total: int) -> DataFrame:
    """rows joined with table, which has each key once; the rows of a hot key go to many tasks, by a hash of by.

    counts: (key, n), the rows of each key or of some of them, of total in all. Hot keys are at most HOT_KEYS, so the
    list of them can be broadcast, and table has one row a task for each of them.
    """
    found = counts.where((F.col("n") > HOT_LEAST) & (F.col("n") * HOT_KEYS > total)).select(key)
    salt, is_hot = fresh([*rows.columns, *table.columns], "salt", "hot")
    hot = F.broadcast(found.withColumn(is_hot, F.lit(True)))
    ways = partitions(rows)
    dealt = rows.join(hot, key, "left").withColumn(salt, F.when(F.col(is_hot), F.pmod(F.xxhash64(by), F.lit(ways))).otherwise(0).cast("int")).drop(is_hot)
    every = F.when(F.col(is_hot), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(table.join(hot, key, "left").withColumn(salt, F.explode(every)).drop(is_hot), [key, salt]).drop(salt)


class Memo(dict):
    """A dict that computes missing entries and starts anew when it holds too many characters."""

    def __init__(self, compute, most: int = 1_500_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def slices(batches: Iterable[pa.RecordBatch], column: str | int = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of a piece have about most bytes, or one text: what bounds a task's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def scratch() -> tempfile.TemporaryDirectory:
    """A task's own spill folder on its executor; it is gone before the task ends, and a retried task makes another."""
    return tempfile.TemporaryDirectory(prefix="spill-", dir=os.environ.get("TMPDIR") or None)
