"""Readers and writers of the files that detection projects exchange, with fixed schemas."""

from __future__ import annotations

import os
import sqlite3
import struct
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of tables that are exchanged.
SCHEMAS = {
    "tile_index": "tile_name string, split string, row_start int, col_start int, tell_count bigint, left double, bottom double, right double, top double",
    "predictions": "tile_name string, prediction_index int, status string, confidence double, best_iou double, matched_ground_truth_index int, x_min double, y_min double, x_max double, y_max double",
    "instances": "polygon_id bigint, tile_name string, ground_truth_index int, matched boolean, matched_confidence double, matched_iou double",
    "objects": "polygon_id bigint, area_m2 double, tile_instances bigint, matched_instances bigint, detected boolean, maximum_matched_confidence double, maximum_matched_iou double, size_class string",
    "raster": "raster_id string, band smallint, row int, col int, value double",
}


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, by a schema or the name of one; empty cells and NaN are null."""
    frame = spark.read.schema(SCHEMAS.get(schema, schema)).csv(path, header=True, nullValue="", nanValue="NaN")
    return frame.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in frame.dtypes))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of strings whose header cells carry stray spaces."""
    frame = spark.read.csv(path, header=True)
    return frame.toDF(*(c.strip() for c in frame.columns))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document a file, by schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files: tile_name, label_index by order in the file, class_id, x_center, y_center, width, height, line.

    Numbers that cannot be read are null; blank lines are left out and not counted.
    """
    whole = spark.read.text(path, wholetext=True).select(stem(F.input_file_name()).alias("tile_name"), F.filter(F.split("value", "\r?\n"), lambda s: F.trim(s) != "").alias("lines"))
    lines = whole.select("tile_name", F.posexplode("lines").alias("label_index", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    numbers = [F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("x_center", "y_center", "width", "height"), 1)]
    return lines.select("tile_name", "label_index", F.get(parts, F.lit(0)).alias("class_id"), *numbers, "line")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, stem and length of the files of a folder, empty ones too; contents are not read.

    The driver asks the folder's file system for the list, as Spark's own readers do.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    rows = [(f.getPath().toString(), f.getLen()) for f in found if f.isFile()]
    return spark.createDataFrame(rows, "path string, length bigint").select("path", stem(F.col("path")).alias("stem"), "length")


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, width and height of PNG files, from the header; null where a file is no PNG."""
    files = spark.read.format("binaryFile").load(path)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    is_png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    return files.select("path", stem(F.col("path")).alias("stem"), F.when(is_png, number(17)).alias("width"), F.when(is_png, number(21)).alias("height"))


def orphans(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, stem) whose stem the other table lacks."""
    return files.join(known.select("stem"), "stem", "left_anti")


def prune(spark: SparkSession, files: DataFrame) -> int:
    """Remove the files of a table (path) from their file system; how many there were. The list comes to the driver in parts."""
    from quadrille.sources.shared import remove

    n = 0
    for n, row in enumerate(files.select("path").toLocalIterator(), 1):
        remove(spark, row["path"])
    return n


def write_table(frame: DataFrame, path: str, header: bool = True) -> None:
    frame.write.mode("overwrite").csv(path, header=header)


def write_matrix(pixels: DataFrame, path: str) -> None:
    """Rows of a raster window as lines of values, without a header, in one file: a window is small."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda s: s["value"].cast("string")), ",")
    pixels.groupBy("row").agg(line.alias("line")).coalesce(1).sortWithinPartitions("row").select("line").write.mode("overwrite").text(path)


def write_report(frame: DataFrame, path: str) -> None:
    """Rows as JSON documents that keep their nulls; NaN, which JSON lacks, is null in numbers of the top level."""
    frame = frame.select(*(F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in frame.dtypes))
    frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def write_labels(lines: DataFrame, path: str) -> None:
    """The text of label files, a folder a tile."""
    from quadrille.operators.tiles import label_text

    label_text(lines).write.mode("overwrite").partitionBy("tile_name").text(path)


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """Vector layers, a Parquet folder each; geometry stays well-known binary."""
    for name, frame in layers.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


GEOMETRY = "geom_wkb binary, x0 double, y0 double, x1 double, y1 double"


def bounds(wkb: bytes) -> tuple[float, float, float, float]:
    """Bounds of a polygon or multipolygon in well-known binary."""
    points = [p for ring in rings(wkb) for p in ring]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def rings(wkb: bytes) -> list[list[tuple[float, float]]]:
    """All rings of a polygon or multipolygon, outer rings first in each part."""
    out: list[list[tuple[float, float]]] = []

    def part(at: int) -> int:
        order = "<" if wkb[at] else ">"
        kind, n = struct.unpack_from(order + "II", wkb, at + 1)
        at += 9
        if kind == 6:
            for _ in range(n):
                at = part(at)
            return at
        if kind != 3:
            raise ValueError(f"no polygon: kind {kind}")
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", wkb, at)
            flat = struct.unpack_from(f"{order}{2 * m}d", wkb, at + 4)
            out.append(list(zip(flat[::2], flat[1::2], strict=True)))
            at += 4 + 16 * m
        return at

    part(0)
    return out


def polygon(*parts: list[tuple[float, float]]) -> bytes:
    """Rings as well-known binary, little-endian."""
    body = b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in parts)
    return struct.pack("<BII", 1, 3, len(parts)) + body


def _package_rows(content: bytes, layer: str, columns: list[str]) -> Iterator[tuple]:
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "layer.gpkg")
        with open(path, "wb") as f:
            f.write(content)
        base = sqlite3.connect(path)
        (geometry,) = base.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
        listed = ", ".join('"' + c.replace('"', '""') + '"' for c in [geometry, *columns])
        for blob, *values in base.execute(f'SELECT {listed} FROM "{layer}"'):
            envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
            wkb = bytes(blob[8 + envelope :])
            yield (*values, wkb, *bounds(wkb))
        base.close()


def read_package(spark: SparkSession, path: str, layer: str, columns: str = "fid bigint") -> DataFrame:
    """A polygon layer of GeoPackage files: the named columns, the geometry and its bounds. A file is one task's."""
    schema = T.StructType.fromDDL(f"{columns}, {GEOMETRY}")
    names = schema.names[:-5]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame(list(_package_rows(bytes(content), layer, names)), columns=schema.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def _shapes(content: bytes) -> Iterator[tuple]:
    at = 100
    while at + 8 <= len(content):
        number, words = struct.unpack_from(">II", content, at)
        (kind,) = struct.unpack_from("<I", content, at + 8)
        if kind in (5, 15):
            parts, points = struct.unpack_from("<II", content, at + 44)
            starts = [*struct.unpack_from(f"<{parts}I", content, at + 52), points]
            flat = struct.unpack_from(f"<{2 * points}d", content, at + 52 + 4 * parts)
            xy = list(zip(flat[::2], flat[1::2], strict=True))
            wkb = polygon(*(xy[a:b] for a, b in zip(starts, starts[1:], strict=False)))
            yield (number, wkb, *bounds(wkb))
        at += 8 + 2 * words


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of .shp files: record number from 1, geometry and bounds; null shapes are left out."""
    schema = T.StructType.fromDDL(f"record bigint, {GEOMETRY}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame(list(_shapes(bytes(content))), columns=schema.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)
