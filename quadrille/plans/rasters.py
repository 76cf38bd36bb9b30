"""Queries over rasters in long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import boxes as B
from quadrille.operators import raster
from quadrille.plans import inputs as I


def q_zscore_uint8(spark, sf):
    """Values as bytes, by each band's own statistics; values of 13 count as missing."""
    px = raster.valid(I.pixels(spark, sf), 13.0)
    byte = raster.standardised(px, raster.scaling(px))
    return byte.groupBy("band", F.col("byte").cast("long").alias("byte")).agg(F.count("*").alias("pixels"))


def q_frozen_scaling(spark, sf):
    """The same by statistics that come from one split only."""
    px = raster.valid(I.pixels(spark, sf))
    stats = raster.scaling(px.where("split = 'F'"))
    byte = raster.standardised(px.where("split = 'O'"), stats)
    return byte.groupBy("band").agg(F.count("*").alias("pixels"), F.sum(F.col("byte").cast("long")).alias("total"), F.min(F.col("byte").cast("long")).alias("least"), F.max(F.col("byte").cast("long")).alias("largest"))


def q_smd(spark, sf):
    s = raster.shift(I.pixels(spark, sf), "split", "F", "O")
    return s.select("band", "F_n", "O_n", *(F.round(c, 6).alias(c) for c in ("F_mean", "O_mean", "F_sd", "O_sd", "difference", "standardised_difference")))


def one_band(spark, sf):
    """A raster of one value a pixel: the largest of those that fall on it, in steps of 25."""
    return I.pixels(spark, sf).groupBy("row", "col").agg((F.floor(F.max("value") / 25) * 25.0).alias("value"))


def q_block(spark, sf):
    return raster.constant_blocks(one_band(spark, sf))


def q_raster_window(spark, sf):
    """The 12 x 12 pixels from the one that holds a map point, and their mean."""
    row, col = raster.pixel_of(455.0, 1_705.0, 0.0, 3_000.0, 10.0)
    w = raster.window(I.pixels(spark, sf), row, col, 12, 12).withColumns({"r": F.col("row") - row, "c": F.col("col") - col})
    return w.groupBy("band", "r", "c").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def q_metadata(spark, sf):
    m = raster.metadata(I.pixels(spark, sf), 10.0, 0.0, 3_000.0, "EPSG:32638")
    first = B.pixel_centre(F.lit(0), 0.0, 10.0)
    return m.withColumn("first_centre", first).withColumn("square", B.close(F.col("right") - F.col("left"), F.col("width") * 10.0))


QUERIES = {f.__name__: f for f in (q_zscore_uint8, q_frozen_scaling, q_smd, q_block, q_raster_window, q_metadata)}

BYTE = "CASE WHEN v IS NULL THEN 128 ELSE round_even((least(3.0, greatest(-3.0, coalesce((v - mean) / nullif(deviation, 0), 0.0))) + 3.0) / 6.0 * 255, 0)::BIGINT END"

ORACLES = {
    "q_zscore_uint8": f"""WITH {I.PIXELS}, n AS (SELECT band, CASE WHEN value <> 13 THEN value END AS v FROM px), s AS (SELECT band, avg(v) AS mean, stddev_pop(v) AS deviation FROM n GROUP BY band)
SELECT band, {BYTE} AS byte, count(*) AS pixels FROM n JOIN s USING (band) GROUP BY 1, 2""",
    "q_frozen_scaling": f"""WITH {I.PIXELS}, s AS (SELECT band, avg(value) AS mean, stddev_pop(value) AS deviation FROM px WHERE split = 'F' GROUP BY band),
b AS (SELECT band, {BYTE} AS byte FROM (SELECT band, value AS v FROM px WHERE split = 'O') JOIN s USING (band))
SELECT band, count(*) AS pixels, sum(byte)::BIGINT AS total, min(byte) AS least, max(byte) AS largest FROM b GROUP BY band""",
    "q_smd": f"""WITH {I.PIXELS}, s AS (SELECT band, count(value) FILTER (split = 'F') AS F_n, count(value) FILTER (split = 'O') AS O_n, avg(value) FILTER (split = 'F') AS fm, avg(value) FILTER (split = 'O') AS om,
  stddev_samp(value) FILTER (split = 'F') AS fs, stddev_samp(value) FILTER (split = 'O') AS os FROM px GROUP BY band)
SELECT band, F_n, O_n, round(fm, 6) AS F_mean, round(om, 6) AS O_mean, round(fs, 6) AS F_sd, round(os, 6) AS O_sd, round(om - fm, 6) AS difference, round((om - fm) / nullif(sqrt((fs * fs + os * os) / 2), 0), 6) AS standardised_difference FROM s""",
    "q_block": f"""WITH {I.PIXELS}, v AS (SELECT row, col, floor(max(value) / 25) * 25 AS value FROM px GROUP BY row, col),
p AS (SELECT i AS row_offset, j AS col_offset FROM (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j)),
b AS (SELECT row_offset, col_offset, (row - row_offset) // 3 AS br, (col - col_offset) // 3 AS bc, min(value) = max(value) AS one FROM v, p WHERE row >= row_offset AND col >= col_offset GROUP BY 1, 2, 3, 4 HAVING count(value) = 9)
SELECT row_offset, col_offset, count(*) FILTER (one) AS constant_blocks, count(*) AS total_blocks, round(100.0 * count(*) FILTER (one) / count(*)::DOUBLE, 6) AS constant_percentage FROM b GROUP BY 1, 2""",
    "q_raster_window": f"""WITH {I.PIXELS}, w AS (SELECT band, row - floor((3000.0 - 1705.0) / 10)::BIGINT AS r, col - floor(455.0 / 10)::BIGINT AS c, value FROM px)
SELECT band, r, c, count(*) AS n, round(avg(value), 6) AS mean FROM w WHERE r BETWEEN 0 AND 11 AND c BETWEEN 0 AND 11 GROUP BY band, r, c""",
    "q_metadata": f"""WITH {I.PIXELS}, m AS (SELECT 'scene' AS raster_id, count(DISTINCT band) AS bands, max(row) + 1 AS height, max(col) + 1 AS width FROM px)
SELECT raster_id, bands, height, width, 'double' AS dtype, 10.0::DOUBLE AS resolution, 'EPSG:32638' AS crs, 0.0::DOUBLE AS "left", 3000.0::DOUBLE - height * 10.0::DOUBLE AS bottom, width * 10.0::DOUBLE AS "right", 3000.0::DOUBLE AS top, 5.0::DOUBLE AS first_centre, true AS square FROM m""",
}
