"""Files in and out, polygons, streams and inference."""

import json
import math
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from quadrille.functions import polygons as P
from quadrille.operators import audit, inference
from quadrille.sources import files
from quadrille.sources.shared import drop_written, shared_folder, written
from quadrille.streaming import tables

L_SHAPE = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(0.5, 0.5), (0.5, 1.5), (1.5, 1.5), (1.5, 0.5), (0.5, 0.5)]


def test_tables_and_logs(spark, tmp_path):
    (tmp_path / "t.csv").write_text("polygon_id,tile_name,ground_truth_index,matched,matched_confidence,matched_iou\n1,a,0,True,0.5,NaN\n2,b,1,False,,\n")
    rows = files.read_table(spark, str(tmp_path / "t.csv"), "instances").collect()
    assert [(r.polygon_id, r.matched, r.matched_confidence, r.matched_iou) for r in rows] == [(1, True, 0.5, None), (2, False, None, None)]
    (tmp_path / "log.csv").write_text("  epoch , metrics/mAP50(B) \n1,0.5\n")
    assert files.read_log(spark, str(tmp_path / "log.csv")).columns == ["epoch", "metrics/mAP50(B)"]


def test_labels_keep_their_order(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "tile_1.txt").write_text("0 0.5 0.5 0.1 0.1\n\n0 x 0.5 0.1 0.1\n")
    (tmp_path / "l" / "tile_2.txt").write_text("")
    rows = files.read_labels(spark, str(tmp_path / "l")).orderBy("label_index").collect()
    assert [(r.tile_name, r.label_index, r.x_center) for r in rows] == [("tile_1", 0, 0.5), ("tile_1", 1, None)]
    listed = files.list_files(spark, str(tmp_path / "l"), "*.txt").collect()
    assert {r.stem for r in listed} == {"tile_1", "tile_2"}
    assert {r.fault for r in audit.lint(files.read_labels(spark, str(tmp_path / "l"))).collect()} == {None, "number"}


def test_reports_and_matrices(spark, tmp_path):
    files.write_report(spark.createDataFrame([(1, float("nan"))], "a int, b double"), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part*"))
    assert json.loads(text) == {"a": 1, "b": None}
    assert files.read_report(spark, str(tmp_path / "r"), "a int, b double").first().a == 1
    files.write_matrix(spark.createDataFrame([(1, 1, 4.0), (0, 1, 2.0), (0, 0, 1.0), (1, 0, 3.0)], "row int, col int, value double"), str(tmp_path / "m"))
    assert "".join(p.read_text() for p in (tmp_path / "m").glob("part*")) == "1.0,2.0\n3.0,4.0\n"
    files.write_table(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "c"))
    assert "a,b\n1,x\n" in [p.read_text() for p in (tmp_path / "c").glob("part*")]


def test_package_and_shapes(spark, tmp_path):
    wkb = files.polygon(L_SHAPE, HOLE)
    base = sqlite3.connect(tmp_path / "a.gpkg")
    base.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    base.execute("INSERT INTO gpkg_geometry_columns VALUES ('sites', 'geom')")
    base.execute("CREATE TABLE sites (fid INTEGER, geom BLOB)")
    base.execute("INSERT INTO sites VALUES (7, ?)", (b"GP\x00\x01" + struct.pack("<i", 32638) + wkb,))
    base.commit()
    base.close()
    row = files.read_package(spark, str(tmp_path / "a.gpkg"), "sites").first()
    assert (row.fid, row.x0, row.y0, row.x1, row.y1) == (7, 0.0, 0.0, 4.0, 4.0)
    points = L_SHAPE + HOLE
    body = struct.pack("<I4dIIII", 5, 0, 0, 4, 4, 2, len(points), 0, len(L_SHAPE)) + b"".join(struct.pack("<dd", *p) for p in points)
    record = struct.pack(">II", 1, len(body) // 2) + body
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + record + struct.pack(">III", 2, 2, 0))
    found = files.read_shapes(spark, str(tmp_path / "a.shp")).collect()
    assert [(r.record, bytes(r.geom_wkb)) for r in found] == [(1, wkb)]


def test_polygon_measures(spark):
    f = spark.createDataFrame([(files.polygon(L_SHAPE, HOLE), 1.0, 1.0, 3.0, 3.0), (None, 0.0, 0.0, 1.0, 1.0)], "g binary, x0 double, y0 double, x1 double, y1 double")
    rows = f.select(P.polygon_area("g").alias("a"), P.area_inside("g", "x0", "y0", "x1", "y1").alias("i"), P.centroid("g").alias("c")).collect()
    assert math.isclose(rows[0].a, 11.0) and math.isclose(rows[0].i, 3.0 - 0.25)
    assert math.isclose(rows[0].c.x, (12 * 5 / 3 - 1) / 11) and rows[1].a is None


def test_polygons_that_overlap(spark):
    """An L with a hole, a square over its corner, and a star whose edges cross."""
    square = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]
    assert math.isclose(P.common_area([L_SHAPE, HOLE], [square]), 3.0 - 0.25) and math.isclose(P.common_area([L_SHAPE, HOLE], [L_SHAPE, HOLE]), 11.0)
    assert P.common_area([square], [[(5.0, 5.0), (6.0, 5.0), (5.0, 6.0)]]) == 0.0
    diamond = [(2.0, 0.0), (4.0, 2.0), (2.0, 4.0), (0.0, 2.0)]
    assert math.isclose(P.common_area([diamond], [square]), 4.0) and math.isclose(P.common_area([diamond], [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]]), 4.0)
    f = spark.createDataFrame([(files.polygon(L_SHAPE, HOLE), files.polygon(square)), (files.polygon([(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]), None)], "a binary, b binary")
    rows = f.select(P.shared_area("a", "b").alias("s"), P.polygon_iou("a", "b").alias("i"), P.polygon_fault("a").alias("fa"), P.polygon_fault("b").alias("fb")).collect()
    assert math.isclose(rows[0].s, 2.75) and math.isclose(rows[0].i, 2.75 / (11 + 4 - 2.75)) and (rows[0].fa, rows[0].fb) == (None, None)
    assert (rows[1].s, rows[1].i, rows[1].fa, rows[1].fb) == (None, None, "no area", "empty")
    assert P.fault([[(0.0, 0.0), (6.0, 5.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]) == "edges cross" and P.fault([[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]) == "too few corners"


def test_image_sizes_and_orphans(spark, tmp_path):
    (tmp_path / "i").mkdir()
    head = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"
    (tmp_path / "i" / "tile_1.png").write_bytes(head + struct.pack(">II", 512, 384) + b"rest")
    (tmp_path / "i" / "tile_2.png").write_bytes(b"no image")
    sizes = files.image_sizes(spark, str(tmp_path / "i"))
    assert {r.stem: (r.width, r.height) for r in sizes.collect()} == {"tile_1": (512, 384), "tile_2": (None, None)}
    lone = files.orphans(files.list_files(spark, str(tmp_path / "i")), spark.createDataFrame([("tile_1",)], "stem string"))
    assert files.prune(spark, lone) == 1 and [p.name for p in (tmp_path / "i").iterdir() if p.suffix == ".png"] == ["tile_1.png"]


def test_label_files(spark, tmp_path):
    rows = [("t1", 1, 0.5, 0.25, 0.1, 0.1), ("t1", 0, 0.1, 0.2, 0.3, 0.4)]
    files.write_labels(spark.createDataFrame(rows, "tile_name string, label_index int, x_center double, y_center double, width double, height double"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out" / "tile_name=t1").glob("part*"))
    assert text == "0 0.100000 0.200000 0.300000 0.400000\n0 0.500000 0.250000 0.100000 0.100000\n"


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match=r"spark.checkpoint.dir"):
        shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://host/shared/"}
    assert shared_folder(Session()) == "hdfs://host/shared"


def test_layers_and_written_tables(spark, tmp_path):
    f = spark.range(5)
    files.write_layers({"a": f, "b": f.limit(2)}, str(tmp_path / "layers"))
    assert spark.read.parquet(str(tmp_path / "layers/b")).count() == 2
    t = written(f, "test")
    assert t.count() == 5
    drop_written(t)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("0 0.5 0.5 0.1 0.1\n0 0.5\n")
    lines = spark.readStream.schema("line string").text(str(tmp_path / "in"))
    query = tables.each_batch(tables.linted(lines), lambda f: f.groupBy("fault").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert {(r.fault, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(None, 1), ("tokens", 1)}
    batch = spark.createDataFrame([("2024-01-01 00:01:00", 0.9), ("2024-01-01 00:06:00", 0.1)], "t string, conf double").withColumn("t", F.to_timestamp("t"))
    assert sorted((r.detections, r.confident) for r in tables.rates(batch, time="t").collect()) == [(1, 0), (1, 1)]


def test_inference_numbers_by_confidence(spark):
    images = spark.createDataFrame([("/x/tile_1.png", bytearray(b"ab")), ("/x/tile_2.png", bytearray(b""))], "path string, content binary")
    found = inference.predicted(images, lambda: lambda b: [(0.05, 0, 0, 1, 1), (0.3, 0, 0, len(b), 1), (0.9, 0, 0, 2, 2)] if b else []).collect()
    assert [(r.tile_name, r.prediction_index, r.confidence) for r in found] == [("tile_1", 0, 0.9), ("tile_1", 1, 0.3)]
