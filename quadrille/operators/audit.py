"""Audits: expectations as rows, label lines, file sets, coverage, contamination, areas of interest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import boxes as B


def expectations(frame: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, passed) of named aggregate conditions, from one pass, and a last row, all: their conjunction."""
    one = frame.agg(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("passed")) for n in checks), F.struct(F.lit("all").alias("check"), F.array_contains(F.array(*(F.col(f"`{n}`") for n in checks)), False).alias("passed")))
    told = one.select(F.explode(rows).alias("r")).select("r.check", "r.passed")
    return told.withColumn("passed", F.when(F.col("check") == "all", ~F.col("passed")).otherwise(F.col("passed")))


def unique(*keys: str) -> Column:
    """The keys are all there and none twice."""
    return (F.count("*") == F.count_distinct(*keys)) & (F.count_if(~F.concat(*(F.col(k).isNotNull().cast("string") for k in keys)).contains("false")) == F.count("*"))


def missing_columns(frame: DataFrame, needed: Sequence[str]) -> list[str]:
    return [c for c in needed if c not in frame.columns]


def required(frame: DataFrame, needed: Sequence[str]) -> DataFrame:
    """The frame, or an error that names the columns it lacks."""
    if lacking := missing_columns(frame, needed):
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return frame


def asserted(frame: DataFrame, holds: Column, message: str) -> DataFrame:
    """The frame; its evaluation fails at the first row for which the condition does not hold."""
    return frame.where(F.coalesce(F.assert_true(holds, message).cast("boolean"), F.lit(True)))


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], *, one_to_one: bool = False) -> DataFrame:
    """Left join whose right side must not repeat a key, and with one_to_one neither the left: fails otherwise."""
    n = right.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in right.columns if c not in keys))
    once = asserted(n, F.col("_n") == 1, "the right side repeats a key").drop("_n")
    if one_to_one:
        m = left.groupBy(*keys).agg(F.count("*").alias("_m"))
        once = once.join(asserted(m, F.col("_m") == 1, "the left side repeats a key").select(*keys), list(keys), "left_semi")
    return left.join(once, list(keys), "left")


def file_differences(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys of one table only: key, side."""
    a, b = first.select(key).distinct(), second.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("first")).unionAll(b.join(a, key, "left_anti").withColumn("side", F.lit("second")))


def lint(lines: DataFrame, text: str = "line") -> DataFrame:
    """Label lines with what is wrong with each: null, or the first rule that it breaks.

    Five tokens; class 0; four finite numbers; centres within 0..1; sizes above 0 up to 1; corners within the image.
    """
    parts = F.split(F.trim(F.col(text)), r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    x, y, w, h = (number(i) for i in range(1, 5))
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    inside = lambda c: c.between(0.0, 1.0)
    corner = lambda c, s: (c - s / 2 >= -1e-6) & (c + s / 2 <= 1 + 1e-6)
    fault = (
        F.when(F.size(parts) != 5, "tokens")
        .when(F.get(parts, F.lit(0)) != "0", "class")
        .when(~(finite(x) & finite(y) & finite(w) & finite(h)), "number")
        .when(~(inside(x) & inside(y)), "centre")
        .when(~((w > 0) & (w <= 1) & (h > 0) & (h <= 1)), "size")
        .when(~(corner(x, w) & corner(y, h)), "corner")
    )
    return lines.withColumn("fault", fault)


def coverage(objects: DataFrame, seen: DataFrame) -> DataFrame:
    """Objects by split: assigned, covered by some tile, and not."""
    hit = seen.select(F.col("r_id").alias("id")).distinct().withColumn("covered", F.lit(True))
    told = objects.join(hit, "id", "left")
    return told.groupBy("split").agg(F.count("*").alias("assigned"), F.count_if("covered").alias("covered"), F.count_if(F.col("covered").isNull()).alias("missing"))


def contamination(tiles: DataFrame, seen: DataFrame, least: float = 0.5) -> DataFrame:
    """Tiles without a label of their own split, and what they show none the less.

    seen: pairs of tiles and objects of any split that share area, from tiles.seen(same_split=False).
    """
    same, boundary = F.col("l_split") == F.col("r_split"), F.col("r_split") == "exclude_boundary"
    labelable = same & (F.col("visible") >= least)
    ids = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("r_id")))), ";")
    found = seen.groupBy(F.col("l_tile_name").alias("tile_name")).agg(
        F.count_if(labelable).alias("labelable"),
        F.count_if(same & (F.col("visible") < least)).alias("same_split_partial"),
        F.count_if(~same & ~boundary).alias("other_split"),
        F.count_if(boundary).alias("excluded_boundary"),
        F.max("visible").alias("max_visible"),
        ids(same & (F.col("visible") < least)).alias("partial_ids"),
    )
    told = tiles.select("tile_name", "split").join(found, "tile_name", "left")
    counts = ("labelable", "same_split_partial", "other_split", "excluded_boundary")
    return told.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).where("labelable = 0").withColumns({"max_visible": F.coalesce("max_visible", F.lit(0.0)), "partial_ids": F.coalesce("partial_ids", F.lit(""))})


def area_of_interest(frame: DataFrame, aoi: B.Box) -> DataFrame:
    """How each box lies to an area: meets it, centre in it, half in it, fully in it, outside."""
    b = B.box()
    x, y = B.centre(b)
    meets = B.overlaps(b, aoi, closed=True)
    share = B.visible(b, aoi)
    return frame.withColumns({"intersects": meets, "centre_inside": B.holds_point(aoi, x, y), "half_inside": share >= 0.5, "fully_inside": B.covers(aoi, b), "outside": ~meets, "share": share})


def decoded(value: Column, known: dict) -> Column:
    """What a map says of a value; null stays null, and a value that the map lacks is an error."""
    of = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    told = F.try_element_at(of, value)
    return F.when(value.isNull(), None).when(told.isNotNull(), told).otherwise(F.raise_error(F.concat(F.lit("unknown value: "), value.cast("string"))))
