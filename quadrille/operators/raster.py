"""Rasters in long form: raster_id, band, row, col, value; what is missing is null."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import boxes as B


def valid(frame: DataFrame, nodata: float | None = None) -> DataFrame:
    """NaN and the nodata value become null."""
    value = B.null_nan(F.col("value"))
    return frame.withColumn("value", value if nodata is None else F.when(value != nodata, value))


def scaling(frame: DataFrame) -> DataFrame:
    """Mean, population deviation, least, largest and number of the values of each band."""
    return frame.groupBy("band").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"), F.min("value").alias("least"), F.max("value").alias("largest"), F.count("value").alias("valid"))


def to_byte(value: Column, mean: Column, deviation: Column, clip: float = 3.0) -> Column:
    """z-score clipped at +-clip, scaled to 0..255, rounded half to even; 128 where the value is missing."""
    z = F.coalesce(F.try_divide(value - mean, deviation), F.lit(0.0))
    scaled = (F.least(F.lit(clip), F.greatest(F.lit(-clip), z)) + clip) / (2 * clip) * 255
    return F.when(value.isNull(), 128).otherwise(F.rint(scaled)).cast("smallint")


def standardised(frame: DataFrame, stats: DataFrame) -> DataFrame:
    """Values as bytes by each band's statistics, which may come from another raster; the table has a row a band."""
    one = stats.select("band", "mean", "deviation")
    return frame.join(F.broadcast(one), "band").withColumn("byte", to_byte(F.col("value"), F.col("mean"), F.col("deviation"))).drop("mean", "deviation")


def shift(frame: DataFrame, split: str, train: str, test: str) -> DataFrame:
    """Per band: numbers, means and sample deviations of two splits, and the standardised difference of the means."""
    of = lambda s, c: F.when(F.col(split) == s, F.col(c))
    aggs = []
    for s in (train, test):
        aggs += [F.count(of(s, "value")).alias(f"{s}_n"), F.avg(of(s, "value")).alias(f"{s}_mean"), F.stddev_samp(of(s, "value")).alias(f"{s}_sd")]
    difference = F.col(f"{test}_mean") - F.col(f"{train}_mean")
    pooled = F.sqrt((F.col(f"{train}_sd") * F.col(f"{train}_sd") + F.col(f"{test}_sd") * F.col(f"{test}_sd")) / 2)
    return frame.groupBy("band").agg(*aggs).withColumn("difference", difference).withColumn("standardised_difference", F.try_divide(difference, pooled))


def window(frame: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    """Pixels of a window; the ranges reach the scan."""
    return frame.where(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))


def pixel_at(x: Column, y: Column, left: float, top: float, resolution: float) -> tuple[Column, Column]:
    """Row and column of the pixel that holds a map point."""
    return F.floor((F.lit(float(top)) - y) / resolution), F.floor((x - F.lit(float(left))) / resolution)


def pixel_of(x: float, y: float, left: float, top: float, resolution: float) -> tuple[int, int]:
    """Row and column of the pixel that holds a map point, as numbers."""
    return floor((top - y) / resolution), floor((x - left) / resolution)


def write_raster(frame: DataFrame, path: str, descriptions: dict[int | str, str] | None = None) -> None:
    """A raster as a Parquet table by raster and band, rows in order inside a file, so that a window reads few row groups.

    descriptions: a text for each band, in a column of its own.
    """
    if descriptions is not None:
        told = F.create_map(*[F.lit(x) for pair in descriptions.items() for x in pair])
        frame = frame.withColumn("description", F.try_element_at(told, F.col("band")))
    frame.repartition("raster_id", "band", F.floor(F.col("row") / 256)).sortWithinPartitions("raster_id", "band", "row", "col").write.mode("overwrite").partitionBy("raster_id", "band").parquet(path)


def constant_blocks(frame: DataFrame, side: int = 3) -> DataFrame:
    """For each of the side x side phases: whole blocks, those of one value, and their percentage.

    All phases come from one scan: a pixel belongs to one block in each.
    """
    phases = F.array(*(F.struct(F.lit(i).alias("row_offset"), F.lit(j).alias("col_offset")) for i in range(side) for j in range(side)))
    dealt = frame.select("row", "col", "value", F.explode(phases).alias("p")).where((F.col("row") >= F.col("p.row_offset")) & (F.col("col") >= F.col("p.col_offset")))
    block = dealt.groupBy("p.row_offset", "p.col_offset", F.floor((F.col("row") - F.col("p.row_offset")) / side).alias("br"), F.floor((F.col("col") - F.col("p.col_offset")) / side).alias("bc"))
    whole = block.agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).where(F.col("n") == side * side)
    total = whole.groupBy("row_offset", "col_offset").agg(F.count_if(F.col("low") == F.col("high")).alias("constant_blocks"), F.count("*").alias("total_blocks"))
    return total.withColumn("constant_percentage", F.round(B.ratio(100.0 * F.col("constant_blocks"), F.col("total_blocks").cast("double")), 6))


def metadata(frame: DataFrame, resolution: float, left: float, top: float, crs: str | None = None) -> DataFrame:
    """A row a raster: bands, height, width, type of the values, resolution, reference system and map bounds."""
    size = frame.groupBy("raster_id").agg(F.count_distinct("band").alias("bands"), (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    kind, res = F.lit(dict(frame.dtypes)["value"]), F.lit(float(resolution))
    return size.select(
        "raster_id", "bands", "height", "width", kind.alias("dtype"), res.alias("resolution"), F.lit(crs).cast("string").alias("crs"),
        F.lit(left).alias("left"), (F.lit(top) - F.col("height") * resolution).alias("bottom"), (F.lit(left) + F.col("width") * resolution).alias("right"), F.lit(top).alias("top"),
    )
