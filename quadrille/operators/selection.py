"""Selections that people review: states, locks, upserts and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, EXCLUDE, PENDING = "keep", "exclude", "replacement_pending_qc"


def decided(frame: DataFrame, excluded: Sequence, key: str = "id") -> DataFrame:
    """Review decisions: excluded keys are out, all others stay as they are."""
    return frame.withColumn("decision", F.when(F.col(key).isin(list(excluded)), EXCLUDE).otherwise(F.col("decision")))


def refilled(frame: DataFrame, pool: DataFrame, k: int, order: Sequence[Column], key: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """Kept rows and, up to k in all, the next of the pool that are neither chosen nor excluded, as pending.

    by: a selection of its own for each value of these columns, which both tables have.
    """
    kept = frame.where(F.col("decision") != EXCLUDE)
    counts = kept.groupBy(*by).agg(F.count("*").alias("_kept"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    free = pool.join(frame.select(key), key, "left_anti").withColumn("_n", place).where(F.col("_n") <= k)  # a selection has few rows
    free = free.join(F.broadcast(counts), list(by), "left") if by else free.crossJoin(F.broadcast(counts))
    more = free.where(F.col("_n") <= k - F.coalesce("_kept", F.lit(0)))
    return kept.unionByName(more.withColumn("decision", F.lit(PENDING)).select(kept.columns))


def locked(frame: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Pending rows become kept, and what is kept is ranked anew, for each value of by."""
    pending = F.coalesce(F.lower("decision").contains("pending"), F.lit(False))
    kept = frame.withColumn("decision", F.when(pending, KEEP).otherwise(F.col("decision"))).where(F.col("decision") == KEEP)
    return kept.withColumn("final_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def upserted(table: DataFrame, rows: DataFrame, keys: Sequence[str], latest: Sequence[Column] | None = None) -> DataFrame:
    """The table with rows put in place of those of the same keys: the same however often it is applied.

    latest orders rows that repeat a key, and the last of them counts; without it a repeated key is an error.
    """
    per = Window.partitionBy(*keys)
    if latest is None:
        one = F.assert_true(F.count("*").over(per) == 1, "a key repeats among the new rows").isNull()
    else:
        one = F.row_number().over(per.orderBy(*latest)) == F.count("*").over(per)
    new = rows.withColumn("_one", one).where("_one").drop("_one")
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def excluded(frame: DataFrame, key: str, *lists: DataFrame) -> DataFrame:
    """Rows whose key is on none of the lists, each a table with the key: the union of exclusions."""
    for one in lists:
        frame = frame.join(one.select(key), key, "left_anti")
    return frame


def paged(frame: DataFrame, size: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Page and place on it, both from 0, in a total order; by: pages of their own for each value of these columns."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return frame.withColumn("_n", n).withColumn("page", F.floor(F.col("_n") / size)).withColumn("place", F.col("_n") % size).drop("_n")


def top(frame: DataFrame, k: int, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """The first k rows of each group, in a total order."""
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
