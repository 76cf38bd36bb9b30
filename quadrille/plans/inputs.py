"""The logical tables of the detection analytics over the test data's tables, in DataFrames and in DuckDB SQL.

Coordinates are whole numbers, so areas and overlaps are exact in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(c: Column, n: int) -> Column:
    return (c % n).cast("double")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tile, x0, y0, x1, y1, conf of each event."""
    e = read(spark, sf_dir, "events")
    x, y, s = _mod(F.col("event_id") * 37, 2048), _mod(F.col("event_id") * 53 + F.col("user_id") * 17, 2048), 20 + F.col("user_id") % 40
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 8).alias("tile"), x.alias("x0"), y.alias("y0"), (x + s).alias("x1"), (y + s).alias("y1"), F.col("value").alias("conf"))


DETECTIONS = """
det AS (
  SELECT event_id AS id, user_id % 8 AS tile,
    CAST((event_id * 37) % 2048 AS DOUBLE) AS x0, CAST((event_id * 53 + user_id * 17) % 2048 AS DOUBLE) AS y0,
    CAST((event_id * 37) % 2048 AS DOUBLE) + 20 + user_id % 40 AS x1, CAST((event_id * 53 + user_id * 17) % 2048 AS DOUBLE) + 20 + user_id % 40 AS y1,
    value AS conf
  FROM events
)"""


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the detections' boxes, moved: id, tile, x0, y0, x1, y1."""
    d = detections(spark, sf_dir).where(F.col("id") % 3 != 0)
    dx, dy = F.col("id") % 11, F.col("id") % 5
    return d.select("id", "tile", (F.col("x0") + dx).alias("x0"), (F.col("y0") + dy).alias("y0"), (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"))


TRUTHS = """
gt AS (
  SELECT id, tile, x0 + id % 11 AS x0, y0 + id % 5 AS y0, x1 + id % 11 AS x1, y1 + id % 5 AS y1 FROM det WHERE id % 3 <> 0
)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known objects, one an order: id, box, area, position, group."""
    o = read(spark, sf_dir, "orders")
    x, y, s = _mod(F.col("o_orderkey") * 131, 100_000), _mod(F.col("o_orderkey") * 71, 40_000), 60 + F.col("o_custkey") % 240
    return o.select(F.col("o_orderkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + s).alias("x1"), (y + s).alias("y1"), F.col("o_totalprice").alias("area"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))


OBJECTS = """
obj AS (
  SELECT o_orderkey AS id, CAST((o_orderkey * 131) % 100000 AS DOUBLE) AS x0, CAST((o_orderkey * 71) % 40000 AS DOUBLE) AS y0,
    CAST((o_orderkey * 131) % 100000 AS DOUBLE) + 60 + o_custkey % 240 AS x1, CAST((o_orderkey * 71) % 40000 AS DOUBLE) + 60 + o_custkey % 240 AS y1,
    o_totalprice AS area, o_orderstatus AS status, o_custkey AS owner
  FROM orders
)"""

# The tile grid of the synthetic scene and its split boundaries along x.
HEIGHT, WIDTH, SIZE, STEP, LEFT, TOP, RESOLUTION = 4_000, 10_000, 512, 384, 0.0, 40_000.0, 10.0
FIRST, SECOND = 70_000.0, 85_005.0


def split_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with the split of their centre; those on a boundary are excluded."""
    x = (F.col("x0") + F.col("x1")) / 2
    crossing = ((F.col("x0") < FIRST) & (FIRST < F.col("x1"))) | ((F.col("x0") < SECOND) & (SECOND < F.col("x1")))
    split = F.when(crossing, "exclude_boundary").when(x < FIRST, "train").when(x < SECOND, "val").otherwise("test")
    return objects(spark, sf_dir).select("id", "x0", "y0", "x1", "y1", split.alias("split"))


SPLIT_OBJECTS = f"""{OBJECTS},
sobj AS (
  SELECT id, x0, y0, x1, y1, CASE WHEN (x0 < {FIRST} AND {FIRST} < x1) OR (x0 < {SECOND} AND {SECOND} < x1) THEN 'exclude_boundary'
    WHEN (x0 + x1) / 2 < {FIRST} THEN 'train' WHEN (x0 + x1) / 2 < {SECOND} THEN 'val' ELSE 'test' END AS split FROM obj
)"""


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("train", LEFT, FIRST), ("val", FIRST, SECOND), ("test", SECOND, LEFT + WIDTH * RESOLUTION)], "split string, x0 double, x1 double")


def tiles_sql(size: int, step: int) -> str:
    return f"""
reg AS (SELECT * FROM (VALUES ('train', {LEFT}, {FIRST}), ('val', {FIRST}, {SECOND}), ('test', {SECOND}, {LEFT + WIDTH * RESOLUTION})) t(split, a, b)),
cr AS (SELECT split, greatest(0, floor((a - {LEFT}) / {RESOLUTION}))::BIGINT AS c0, least({WIDTH}, ceil((b - {LEFT}) / {RESOLUTION}))::BIGINT AS c1 FROM reg),
cols AS (SELECT split, unnest(list_concat(range(c0, c1 - {size} + 1, {step}), [c1 - {size}])) AS col_start FROM cr WHERE c1 - {size} >= c0),
rws AS (SELECT unnest(list_concat(range(0, {HEIGHT - size} + 1, {step}), [{HEIGHT - size}])) AS row_start),
cells AS (SELECT DISTINCT split, row_start::BIGINT AS row_start, col_start::BIGINT AS col_start FROM cols, rws),
tiles AS (
  SELECT split, split || '_' || lpad((row_number() OVER (PARTITION BY split ORDER BY row_start, col_start) - 1)::VARCHAR, 4, '0') || '_' || row_start || '_' || col_start AS tile_name, row_start, col_start,
    {LEFT} + col_start * {RESOLUTION}::DOUBLE AS x0, {TOP} - (row_start + {size}) * {RESOLUTION}::DOUBLE AS y0, {LEFT} + (col_start + {size}) * {RESOLUTION}::DOUBLE AS x1, {TOP} - row_start * {RESOLUTION}::DOUBLE AS y1
  FROM cells
)"""


TILES = tiles_sql(SIZE, STEP)


def inter(a: str, b: str) -> str:
    return f"(greatest(0.0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0.0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"


def area(a: str) -> str:
    return f"(greatest(0.0, {a}.x1 - {a}.x0) * greatest(0.0, {a}.y1 - {a}.y0))"


def iou(a: str, b: str) -> str:
    return f"(CASE WHEN {area(a)} + {area(b)} - {inter(a, b)} > 0 THEN {inter(a, b)} / ({area(a)} + {area(b)} - {inter(a, b)}) ELSE 0.0 END)"


def apart(a: str, b: str) -> str:
    return f"{a}.x0 < {b}.x1 AND {b}.x0 < {a}.x1 AND {a}.y0 < {b}.y1 AND {b}.y0 < {a}.y1"


SEEN = f"""
seen AS (
  SELECT t.split, t.tile_name, o.split AS osplit, o.id, {inter("o", "t")} / {area("o")} AS visible,
    greatest(o.x0, t.x0) AS cx0, greatest(o.y0, t.y0) AS cy0, least(o.x1, t.x1) AS cx1, least(o.y1, t.y1) AS cy1, t.x0, t.y0, t.x1, t.y1
  FROM tiles t JOIN sobj o ON {apart("t", "o")}
)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as pixels: a raster of one value a row, band by flag."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.lit("scene").alias("raster_id"), F.col("l_returnflag").alias("band"), (F.col("l_orderkey") % 300).alias("row"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 200).alias("col"), F.col("l_quantity").alias("value"), F.col("l_linestatus").alias("split"))


PIXELS = """
px AS (
  SELECT l_returnflag AS band, l_orderkey % 300 AS row, (l_partkey * 7 + l_linenumber) % 200 AS col, l_quantity AS value, l_linestatus AS split FROM lineitem
)"""
