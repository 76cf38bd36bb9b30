"""Tile grids over a raster and the labels of the objects that tiles show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import boxes as B
from quadrille.operators.spatial import overlap_pairs, without_overlap


def grid(regions: DataFrame, *, height: int, width: int, size: int, step: int, left: float, top: float, resolution: float, clip_columns: bool = True) -> DataFrame:
    """Tiles of each region (split, x0, x1 in map units): name, row and column starts, map bounds, number in the split.

    A region takes the columns from the floor of its left edge to the ceiling of its right one; windows step over them
    and one more is flush with the end. Regions narrower than a tile have none.
    """
    first, end = B.columns_of(F.col("x0"), F.col("x1"), left, resolution, width)
    rows = B.starts(F.lit(0).cast("bigint"), F.lit(height).cast("bigint"), size, step)
    cells = regions.select("split", F.explode(B.starts(first, end, size, step)).alias("col_start")).withColumn("row_start", F.explode(rows))
    number = F.row_number().over(Window.partitionBy("split").orderBy("row_start", "col_start")) - 1
    bounds = B.window_bounds(F.col("row_start"), F.col("col_start"), size, left, top, resolution)
    name = F.format_string("%s_%04d_%d_%d", F.col("split"), number, F.col("row_start"), F.col("col_start"))
    return cells.select("split", name.alias("tile_name"), "row_start", "col_start", *(c.alias(n) for c, n in zip(bounds, ("x0", "y0", "x1", "y1"), strict=True)))


def parsed_name(name) -> list:
    """split, number, row and column of a tile's name; null where it is no such name."""
    pattern = r"^(.+)_(\d+)_(\d+)_(\d+)$"
    part = lambda i: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, i))
    return [part(1).alias("split"), *(part(i).cast("bigint").alias(n) for i, n in ((2, "tile_number"), (3, "row_start"), (4, "col_start")))]


def seen(tiles: DataFrame, objects: DataFrame, *, cell: float, same_split: bool = True) -> DataFrame:
    """Objects that share area with tiles: tile columns, id, visible share and whether their split is the tile's."""
    pairs = overlap_pairs(tiles, objects, cell=cell, also=(F.col("l_split") == F.col("r_split")) if same_split else None)
    return pairs.withColumn("visible", B.visible(B.box("r_"), B.box("l_")))


def labels(tiles: DataFrame, objects: DataFrame, *, cell: float, least: float = 0.5) -> DataFrame:
    """Label lines: for each tile the objects seen at least so much, clipped to it, in shares of the tile, by id."""
    shown = seen(tiles, objects, cell=cell).where(F.col("visible") >= least)
    x, y, w, h = B.map_to_unit(B.clip(B.box("r_"), B.box("l_")), B.box("l_"))
    index = F.row_number().over(Window.partitionBy("l_tile_name").orderBy("r_id")) - 1
    return shown.select(F.col("l_split").alias("split"), F.col("l_tile_name").alias("tile_name"), index.alias("label_index"), F.col("r_id").alias("id"), x.alias("x_center"), y.alias("y_center"), w.alias("width"), h.alias("height"))


def label_text(lines: DataFrame) -> DataFrame:
    """The text of each tile's label file: a line an object, six decimals, in the order of the index."""
    line = F.format_string("0 %.6f %.6f %.6f %.6f", "x_center", "y_center", "width", "height")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label_index", line.alias("line")))), lambda s: s["line"]), "\n")
    return lines.groupBy("tile_name").agg(joined.alias("text"))


def counts(tiles: DataFrame, lines: DataFrame) -> DataFrame:
    """Tiles of each split: all, with labels, without, and labels in all."""
    n = lines.groupBy("tile_name").agg(F.count("*").alias("n"))
    joined = tiles.join(n, "tile_name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.groupBy("split").agg(F.count("*").alias("tiles"), F.count_if(F.col("n") > 0).alias("positive_tiles"), F.count_if(F.col("n") == 0).alias("background_tiles"), F.sum("n").alias("labels"))


def mined(spark: SparkSession, tries: int, seed: int, *, width: int, height: int, size: int) -> DataFrame:
    """Windows at hashed origins, each place once: attempt, the first of those that gave it, row_start, col_start."""
    number = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/{salt}/"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    tried = spark.range(tries).select(F.col("id").alias("attempt"), (number(1) % (height - size + 1)).alias("row_start"), (number(2) % (width - size + 1)).alias("col_start"))
    return tried.groupBy("row_start", "col_start").agg(F.min("attempt").alias("attempt"))


def clean_windows(windows: DataFrame, objects: DataFrame, k: int, *, region: tuple[float, float], size: int, left: float, top: float, resolution: float, cell: float, used: DataFrame | None = None) -> DataFrame:
    """The first k windows by attempt that lie in a region along x, touch no object and are not used (row_start, col_start).

    Rejection sampling, all tries at once; fewer than k if the tries do not give as many.
    """
    bounds = B.window_bounds(F.col("row_start"), F.col("col_start"), size, left, top, resolution)
    placed = windows.select("attempt", "row_start", "col_start", *(c.alias(n) for c, n in zip(bounds, ("x0", "y0", "x1", "y1"), strict=True)))
    inside = placed.where((F.col("x0") >= region[0]) & (F.col("x1") <= region[1]))
    if used is not None:
        inside = inside.join(used.select("row_start", "col_start"), ["row_start", "col_start"], "left_anti")
    return without_overlap(inside, objects, "attempt", cell=cell).orderBy("attempt").limit(k)
