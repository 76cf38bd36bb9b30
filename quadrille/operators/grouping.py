"""Grouping over fixed domains, totals beside groups, exact quantiles and classes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.sources.shared import written


def domain(frame: DataFrame, values: dict[str, Sequence[str]]) -> DataFrame:
    """All combinations of the named columns' values: a small table of literals."""
    names = list(values)
    return frame.sparkSession.createDataFrame([tuple(row) for row in product(*values.values())], ", ".join(f"{n} string" for n in names))


def dense(frame: DataFrame, values: dict[str, Sequence[str]], aggregates: Sequence[Column], zero: Sequence[str] = ()) -> DataFrame:
    """Aggregates for every combination of the domain, also those without rows; zero: columns that are then 0."""
    names = list(values)
    found = frame.groupBy(*names).agg(*aggregates)
    filled = domain(frame, values).join(found, names, "left")
    return filled.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def with_total(frame: DataFrame, key: str, aggregates: Sequence[Column], total: str) -> DataFrame:
    """Aggregates a group and of all rows, in one pass; the row of all has the key total."""
    grouped = frame.rollup(key).agg(F.grouping(key).alias("_all"), *aggregates)
    return grouped.withColumn(key, F.when(F.col("_all") == 1, total).otherwise(F.col(key))).drop("_all")


#: Half the share of rows among which an exact quantile is looked for, the accuracy of the sketch that says where, and
#: rows up to which the values of a group are put in order at once, over 8,000 as a bracket has to hold neighbours.
NEAR, ACCURACY, FEW = 1 / 4_000, 20_000, 200_000


def quantiles(frame: DataFrame, value: Column, at: Sequence[float], by: str | None = None) -> DataFrame:
    """One row, q: exact quantiles, linear between neighbours, nulls left out; of no rows they are null.

    by: a row (by, q) for each value of a column that has few of them. Two passes: a sketch gives each quantile a bracket
    of values that is sure to hold it; then the rows below are counted, and only the distinct values inside, a small
    share of the rows, are put in order. So no task holds all values of a large table.
    """
    key = F.col(by) if by else F.lit(0)
    known = frame.select(key.alias("k"), value.cast("double").alias("v")).where("v IS NOT NULL")
    cuts = [min(1.0, max(0.0, p + side * NEAR)) for p in at for side in (-1, 1)]
    ends = written(known.groupBy("k").agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*map(F.lit, cuts)), F.lit(ACCURACY)).alias("e")), "brackets")
    if (ends.agg(F.max("n")).first()[0] or 0) <= FEW:
        found = known.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, at))).alias("q"))
    else:
        spans = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), F.get("e", F.lit(2 * i)).alias("lo"), F.get("e", F.lit(2 * i + 1)).alias("hi")) for i, p in enumerate(at)))
        met = F.explode(F.filter(spans, lambda s: F.col("v") <= s["hi"])).alias("s")
        parts = known.join(F.broadcast(ends), "k").select("k", "n", "v", met).select("k", "n", "s.i", "s.p", F.when(F.col("v") >= F.col("s.lo"), F.col("v")).alias("v"))
        counted = parts.groupBy("k", "n", "i", "p", "v").agg(F.count("*").alias("rows"))
        end = counted.withColumn("end", F.sum("rows").over(Window.partitionBy("k", "i").orderBy(F.col("v").asc_nulls_first())))
        place = F.col("p") * (F.col("n") - 1)
        value_at = lambda rank: F.min(F.when(F.col("end") > rank, F.col("v")))
        pairs = end.groupBy("k", "i", place.alias("place")).agg(value_at(F.floor(place)).alias("a"), value_at(F.floor(place) + 1).alias("b"))
        between = F.col("a") + (F.coalesce("b", "a") - F.col("a")) * (F.col("place") - F.floor("place"))
        listed = pairs.select("k", "i", between.alias("x")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l"))
        found = listed.select("k", F.transform("l", lambda s: s["x"]).alias("q"))
    if by:
        return found.withColumnRenamed("k", by)
    none = frame.sparkSession.createDataFrame([(0, [None] * len(at))], "k int, none array<double>")
    return none.join(found, "k", "left").select(F.coalesce("q", "none").alias("q"))


def quantile_table(frame: DataFrame, value: str, at: dict[str, float], name: str) -> DataFrame:
    """A row for each named quantile: dataset, quantile, value."""
    one = quantiles(frame, F.col(value), list(at.values()))
    pairs = F.arrays_zip(F.array(*map(F.lit, at)).alias("quantile"), F.col("q").alias("value"))
    return one.select(F.explode(pairs).alias("p")).select(F.lit(name).alias("dataset"), F.col("p.quantile").alias("quantile"), F.col("p.value").alias("value"))


def by_bounds(value: Column, bounds: Sequence[Column | float], names: Sequence[str], *, right_closed: bool) -> Column:
    """The name of the interval a value falls into; null values have none."""
    out = F.when(value.isNull(), None)
    for bound, name in zip(bounds, names, strict=False):
        out = out.when(value <= bound if right_closed else value < bound, name)
    return out.otherwise(names[-1])


def size_class(value: Column, small: float, large: float) -> Column:
    """small up to and with the first bound, large from and with the second, medium between."""
    return F.when(value.isNull(), None).when(value <= small, "small").when(value < large, "medium").otherwise("large")


def argmax(frame: DataFrame, value: str, first: str, columns: Sequence[str]) -> list[Column]:
    """Columns of the row with the largest value, the smallest first among ties."""
    key = F.struct(F.col(value), -F.col(first))
    return [F.max_by(c, key).alias(f"best_{c}") for c in columns]


def cross_tab(frame: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts by two columns, one output column a value, 0 where none."""
    out = frame.groupBy(rows).pivot(columns, list(values)).agg(F.count(F.lit(1)))
    return out.select(rows, *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"n_{v}") for v in values))


def ranked(frame: DataFrame, name: str, *order: Column) -> DataFrame:
    """Row numbers over the whole table in a total order: for selections, which are small."""
    return frame.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def numbered(frame: DataFrame, name: str, *order: Column) -> DataFrame:
    """Row numbers from 1 over a whole table of any size, in a total order.

    The table is range-partitioned by the order and written; a row's number is its number in its partition and the rows
    of the partitions before, of which there is a row each.
    """
    within = Window.partitionBy("_part").orderBy(*order)
    dealt = written(frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.row_number().over(within) + F.col("_before")).drop("_part", "_before")


def stratified(frame: DataFrame, strata: str, key: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """Up to sizes[stratum] rows of each stratum in a seeded hash order, the same at every run."""
    most = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    order = Window.partitionBy(strata).orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")).cast("binary")), F.col(key))
    return frame.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.coalesce(F.element_at(most, F.col(strata)), F.lit(0))).drop("_n")
