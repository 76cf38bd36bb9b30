"""Queries over objects and tiles: splits, sizes, positions, grids, labels and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import boxes as B
from quadrille.operators import audit, grouping, spatial, tiles
from quadrille.plans import inputs as I
from quadrille.sources.shared import written

# The areas up to which objects are small and from which they are large, for the synthetic areas.
SMALL, LARGE = 150_000.0, 300_000.0
CLASSES, THIRDS = ["small", "medium", "large"], ["west", "middle", "east"]
CELL = 2_000.0


#: Tiles of the audits of tiles without labels, of which the large ones have none: side and step.
FINE = 64


def grid(spark, size=I.SIZE, step=I.STEP):
    return tiles.grid(I.regions(spark), height=I.HEIGHT, width=I.WIDTH, size=size, step=step, left=I.LEFT, top=I.TOP, resolution=I.RESOLUTION)


def split(spark, sf):
    """Objects split at the quantiles of all positions, boundary crossers excluded afterwards."""
    o = I.objects(spark, sf).withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    q = grouping.quantiles(o, F.col("cx"), [0.7, 0.85])
    b1, b2 = F.col("q")[0], F.col("q")[1]
    told = o.crossJoin(F.broadcast(q)).withColumn("split", grouping.by_bounds(F.col("cx"), [b1, b2], ["train", "val", "test"], right_closed=False))
    crossing = B.crosses(F.col("x0"), F.col("x1"), b1) | B.crosses(F.col("x0"), F.col("x1"), b2)
    return told.withColumn("split", F.when(crossing, "exclude_boundary").otherwise(F.col("split")))


def q_split(spark, sf):
    return split(spark, sf).where(F.col("split").isin("train", "val", "test", "exclude_boundary")).groupBy("split").agg(F.count("*").alias("objects"), F.round(F.min("cx"), 6).alias("from_x"), F.round(F.max("cx"), 6).alias("to_x"))


def classed(spark, sf):
    return I.objects(spark, sf).withColumn("size_class", grouping.size_class(F.col("area"), SMALL, LARGE))


def q_size_class(spark, sf):
    return grouping.dense(classed(spark, sf), {"size_class": [*CLASSES, "huge"]}, [F.count("*").alias("objects"), F.count_if(F.col("status") == "F").alias("finished")], ["objects", "finished"])


def instances(spark, sf):
    """Sightings of objects, one a lineitem: id, matched, confidence where matched."""
    li = I.read(spark, sf, "lineitem")
    matched = (F.col("l_linenumber") % 3 == 1) & (F.col("l_quantity") > 20)
    return li.select(F.col("l_orderkey").alias("id"), matched.alias("matched"), F.when(matched, F.col("l_discount")).alias("conf"))


INSTANCES = "ins AS (SELECT l_orderkey AS id, l_linenumber % 3 = 1 AND l_quantity > 20 AS matched, CASE WHEN l_linenumber % 3 = 1 AND l_quantity > 20 THEN l_discount END AS conf FROM lineitem)"


def recalled(spark, sf):
    seen = instances(spark, sf).groupBy("id").agg(F.count("*").alias("instances"), F.count_if("matched").alias("matched_instances"), F.bool_or("matched").alias("detected"), F.max("conf").alias("max_conf"))
    told = classed(spark, sf).join(seen, "id", "left")
    return told.withColumns({"instances": F.coalesce("instances", F.lit(0)), "matched_instances": F.coalesce("matched_instances", F.lit(0)), "detected": F.coalesce("detected", F.lit(False))})


RECALLED = f"""{I.OBJECTS}, {INSTANCES},
sn AS (SELECT id, count(*) AS instances, count(*) FILTER (matched) AS matched_instances, bool_or(matched) AS detected, max(conf) AS max_conf FROM ins GROUP BY id),
rec AS (SELECT o.*, CASE WHEN area <= {SMALL} THEN 'small' WHEN area < {LARGE} THEN 'medium' ELSE 'large' END AS size_class,
  coalesce(instances, 0) AS instances, coalesce(matched_instances, 0) AS matched_instances, coalesce(detected, false) AS detected, max_conf FROM obj o LEFT JOIN sn USING (id))"""


def q_object_recall(spark, sf):
    return recalled(spark, sf).select("id", "area", "size_class", "instances", "matched_instances", "detected", F.coalesce("max_conf", F.lit(-1.0)).alias("max_conf"))


def q_size_recall(spark, sf):
    aggs = [F.count("*").alias("objects"), F.count_if("detected").alias("detected"), F.count_if(~F.col("detected")).alias("missed"), F.round(F.avg(F.col("detected").cast("double")), 6).alias("recall")]
    return grouping.with_total(recalled(spark, sf).select("size_class", "detected"), "size_class", aggs, "overall")


def q_quartile_table(spark, sf):
    at = {"Q1": 0.25, "median": 0.5, "Q3": 0.75}
    o = I.objects(spark, sf)
    return grouping.quantile_table(o, "area", at, "all").unionAll(grouping.quantile_table(o.where("status = 'F'"), "area", at, "finished"))


def thirds(spark, sf, base=None):
    """Objects with distance from the west edge and the third of the range they lie in, right-closed."""
    o = (recalled(spark, sf) if base is None else base).withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    ends = o.agg(F.min("cx").alias("west"), F.max("cx").alias("east"))
    placed = o.crossJoin(F.broadcast(ends)).withColumn("distance_km", (F.col("cx") - F.col("west")) / 1000).withColumn("relative", B.ratio(F.col("cx") - F.col("west"), F.col("east") - F.col("west")))
    return placed.withColumn("third", grouping.by_bounds(F.col("relative"), [F.lit(1.0) / 3, F.lit(2.0) / 3], THIRDS, right_closed=True))


THIRD = f"""{RECALLED},
pos AS (SELECT *, (x0 + x1) / 2 AS cx FROM rec), ends AS (SELECT min(cx) AS west, max(cx) AS east FROM pos),
rel AS (SELECT pos.*, (cx - west) / 1000 AS distance_km, (cx - west) / (east - west) AS relative FROM pos, ends),
thirds AS (SELECT *, CASE WHEN relative <= 1.0::DOUBLE / 3 THEN 'west' WHEN relative <= 2.0::DOUBLE / 3 THEN 'middle' ELSE 'east' END AS third FROM rel)"""


def q_thirds(spark, sf):
    """Recall by third; the joined table must not repeat an object."""
    base = written(recalled(spark, sf).select("id", "x0", "x1", "detected"), "recalled")  # read three times
    places = thirds(spark, sf, base).select("id", "third")
    joined = audit.lookup(base.select("id", "detected"), places, ["id"], one_to_one=True)
    return joined.groupBy("third").agg(F.count("*").alias("objects"), F.count_if("detected").alias("detected"), F.round(F.avg(F.col("detected").cast("double")), 6).alias("recall"))


def q_thirds_size(spark, sf):
    out = grouping.dense(thirds(spark, sf), {"third": THIRDS, "size_class": [*CLASSES, "huge"]}, [F.count("*").alias("objects"), F.count_if("detected").alias("detected")], ["objects", "detected"])
    return out.withColumn("recall", F.coalesce(F.round(F.try_divide(F.col("detected").cast("double"), F.col("objects").cast("double")), 6), F.lit(-1.0)))


def q_location(spark, sf):
    base = written(recalled(spark, sf).select("id", "x0", "x1", "detected"), "recalled")
    t = thirds(spark, sf, base).withColumn("status", F.when(F.col("detected"), "detected").otherwise("missed"))
    middle = grouping.quantiles(t, F.col("distance_km"), [0.5], by="status").select("status", F.round(F.col("q")[0], 6).alias("median_km"))
    out = t.groupBy("status").agg(F.count("*").alias("objects"), F.round(F.avg("distance_km"), 6).alias("mean_km"), F.round(F.avg("relative"), 6).alias("mean_relative"))
    return out.join(F.broadcast(middle), "status")


def q_crosstab(spark, sf):
    return grouping.cross_tab(thirds(spark, sf), "third", "size_class", CLASSES)


def q_bands(spark, sf):
    """Recall in five bands of equal width from south to north."""
    o = recalled(spark, sf)
    band = F.least(F.lit(5), F.width_bucket(F.col("y0"), F.lit(0.0), F.lit(40_000.0), F.lit(5)))
    return o.groupBy(band.cast("long").alias("band")).agg(F.count("*").alias("objects"), F.count_if("detected").alias("detected"), F.round(F.avg(F.col("detected").cast("double")), 6).alias("recall"))


def q_grid_corr(spark, sf):
    """Correlation of counts of objects and of detected ones over the cells of a 10 x 10 grid, empty cells too."""
    cell = [F.least(F.lit(9), F.floor(F.col("x0") / 10_000)).cast("bigint").alias("gx"), F.least(F.lit(9), F.floor(F.col("y0") / 4_000)).cast("bigint").alias("gy")]
    n = recalled(spark, sf).groupBy(*cell).agg(F.count("*").alias("n"), F.count_if("detected").alias("d"))
    every = spark.range(10).select(F.col("id").alias("gx"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).alias("gy"))
    filled = every.join(n, ["gx", "gy"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "d": F.coalesce("d", F.lit(0))})
    return filled.agg(F.count("*").alias("cells"), F.sum("n").alias("objects"), F.round(F.corr("n", "d"), 6).alias("r"))


def q_agreement(spark, sf):
    """Two by two: whether a detection's box holds a known point, against whether its confidence is high."""
    d = I.detections(spark, sf)
    points = I.objects(spark, sf).select((F.col("x0") % 2048).alias("px"), (F.col("y0") % 2048).alias("py"))
    hit = spatial.boxes_with_points(points, d, "id", cell=64.0).withColumn("site", F.lit(True))
    told = d.join(hit, "id", "left").select(F.when(F.col("conf") >= 50, "yes").otherwise("no").alias("label"), F.coalesce("site", F.lit(False)).alias("site"))
    out = told.groupBy("label").agg(F.count_if("site").alias("site_inside"), F.count_if(~F.col("site")).alias("no_site"))
    return out.withColumn("site_share", F.round(B.ratio(F.col("site_inside").cast("double"), (F.col("site_inside") + F.col("no_site")).cast("double")), 6))


def q_tiles(spark, sf):
    g = grid(spark)
    return g.select("tile_name", "split", "row_start", "col_start", "x0", "y0", "x1", "y1", tiles.parsed_name(F.col("tile_name"))[1].alias("tile_number"))


def q_tile_label(spark, sf):
    lines = tiles.labels(grid(spark), I.split_objects(spark, sf), cell=CELL)
    return lines.select("tile_name", F.col("label_index").cast("long").alias("label_index"), "id", "x_center", "y_center", "width", "height")


def q_tile_summary(spark, sf):
    g = grid(spark)
    return tiles.counts(g, tiles.labels(g, I.split_objects(spark, sf), cell=CELL))


def q_coverage(spark, sf):
    seen = tiles.seen(grid(spark), I.split_objects(spark, sf), cell=CELL).where("visible >= 0.5")
    return audit.coverage(I.split_objects(spark, sf), seen)


def q_contamination(spark, sf):
    g = grid(spark, FINE, FINE)
    found = audit.contamination(g, tiles.seen(g, I.split_objects(spark, sf), cell=1_000.0, same_split=False))
    any_ = (F.col("same_split_partial") > 0) | (F.col("other_split") > 0) | (F.col("excluded_boundary") > 0)
    aggs = [F.count("*").alias("background_tiles"), F.count_if(F.col("same_split_partial") > 0).alias("partial_tiles"), F.count_if(F.col("other_split") > 0).alias("cross_split_tiles"), F.count_if(F.col("excluded_boundary") > 0).alias("boundary_tiles"), F.count_if(any_).alias("any_tiles"), F.round(F.max("max_visible"), 6).alias("max_visible"), F.max("partial_ids").alias("last_partial_ids")]
    out = grouping.with_total(found, "split", aggs, "ALL")
    return out.withColumn("any_percent", F.round(B.ratio(100.0 * F.col("any_tiles"), F.col("background_tiles").cast("double")), 6))


def q_hidden_positive(spark, sf):
    """Tiles of each split that only show parts of objects, and those saved to the dataset (even columns)."""
    g = grid(spark, FINE, FINE)
    seen = tiles.seen(g, I.split_objects(spark, sf), cell=1_000.0)
    n = seen.groupBy(F.col("l_tile_name").alias("tile_name")).agg(F.count_if(F.col("visible") >= 0.5).alias("labelled"), F.count_if(F.col("visible") < 0.5).alias("partial"))
    saved = g.where("col_start % 2 = 0").select("split", "row_start", "col_start").withColumn("saved", F.lit(True))
    told = g.join(n, "tile_name", "left").join(saved, ["split", "row_start", "col_start"], "left")
    told = told.withColumns({"labelled": F.coalesce("labelled", F.lit(0)), "partial": F.coalesce("partial", F.lit(0)), "saved": F.col("saved").isNotNull()}).withColumn("hidden", (F.col("labelled") == 0) & (F.col("partial") > 0))
    return told.groupBy("split").agg(F.count("*").alias("tiles"), F.count_if("hidden").alias("hidden"), F.count_if(F.col("hidden") & F.col("saved")).alias("hidden_saved"), F.count_if(~F.col("hidden") & ~F.col("saved")).alias("unsaved"))


def q_aoi(spark, sf):
    aoi = tuple(F.lit(v) for v in (20_000.0, 10_000.0, 60_040.0, 30_040.0))
    a = audit.area_of_interest(I.objects(spark, sf), aoi)
    q = grouping.quantiles(a, F.col("share"), [0.25, 0.5, 0.75])
    out = a.agg(*(F.count_if(c).alias(c) for c in ("intersects", "centre_inside", "half_inside", "fully_inside", "outside")), F.count("*").alias("n"), F.round(F.avg("share"), 6).alias("mean"), F.round(F.stddev_samp("share"), 6).alias("sd"), F.min("share").alias("least"), F.max("share").alias("most"))
    return out.crossJoin(F.broadcast(q)).select("*", *(F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3))).drop("q")


#: Side of the windows that are mined, tries, and windows wanted.
MINED, TRIES, POOL = 32, 50_000, 400


def q_clean_pool(spark, sf):
    """The first 400 of 50,000 hashed windows that lie in the first region and touch no object."""
    tried = tiles.mined(spark, TRIES, 42, width=I.WIDTH, height=I.HEIGHT, size=MINED)
    pool = tiles.clean_windows(tried, I.objects(spark, sf), POOL, region=(I.LEFT, I.FIRST), size=MINED, left=I.LEFT, top=I.TOP, resolution=I.RESOLUTION, cell=500.0)
    return pool.select("attempt", "row_start", "col_start")


def q_dataset_check(spark, sf):
    """Per split: tiles, labels and coverage side by side."""
    tiles_ = q_tile_summary(spark, sf).select("split", "tiles", "labels")
    return tiles_.join(q_coverage(spark, sf), "split").select("split", "tiles", "labels", "assigned", "covered", "missing")


def q_sample(spark, sf):
    """Up to four objects that were found and two that were not, of each size class, in hash order."""
    told = recalled(spark, sf).withColumn("stratum", F.concat_ws("/", "size_class", F.col("detected").cast("string")))
    sizes = {f"{c}/{d}": n for c in CLASSES for d, n in (("true", 4), ("false", 2))}
    return grouping.stratified(told, "stratum", "id", sizes, 42).select("stratum", "id")


QUERIES = {f.__name__: f for f in (q_split, q_size_class, q_object_recall, q_size_recall, q_quartile_table, q_thirds, q_thirds_size, q_location, q_crosstab, q_bands, q_grid_corr, q_agreement, q_tiles, q_tile_label, q_tile_summary, q_coverage, q_contamination, q_hidden_positive, q_aoi, q_clean_pool, q_dataset_check, q_sample)}

SEEN = f"{I.SPLIT_OBJECTS}, {I.TILES}, {I.SEEN}"
LAB = "lab AS (SELECT * FROM seen WHERE split = osplit AND visible >= 0.5)"
FINE_SEEN = f"{I.SPLIT_OBJECTS}, {I.tiles_sql(FINE, FINE)}, {I.SEEN}"
SUMMARY = "nl AS (SELECT tile_name, count(*) AS n FROM lab GROUP BY tile_name), summ AS (SELECT split, count(*) AS tiles, count(*) FILTER (coalesce(n, 0) > 0) AS positive_tiles, count(*) FILTER (coalesce(n, 0) = 0) AS background_tiles, sum(coalesce(n, 0))::BIGINT AS labels FROM tiles LEFT JOIN nl USING (tile_name) GROUP BY split)"
COVER = "cov AS (SELECT split, count(*) AS assigned, count(*) FILTER (id IN (SELECT id FROM lab)) AS covered, count(*) FILTER (id NOT IN (SELECT id FROM lab)) AS missing FROM sobj GROUP BY split)"

ORACLES = {
    "q_split": f"""WITH {I.OBJECTS}, c AS (SELECT *, (x0 + x1) / 2 AS cx FROM obj), q AS (SELECT quantile_cont(cx, 0.7) AS b1, quantile_cont(cx, 0.85) AS b2 FROM c),
s AS (SELECT cx, CASE WHEN (x0 < b1 AND b1 < x1) OR (x0 < b2 AND b2 < x1) THEN 'exclude_boundary' WHEN cx < b1 THEN 'train' WHEN cx < b2 THEN 'val' ELSE 'test' END AS split FROM c, q)
SELECT split, count(*) AS objects, round(min(cx), 6) AS from_x, round(max(cx), 6) AS to_x FROM s GROUP BY split""",
    "q_size_class": f"""WITH {RECALLED}, d AS (SELECT unnest(['small', 'medium', 'large', 'huge']) AS size_class)
SELECT size_class, count(rec.id) AS objects, count(rec.id) FILTER (status = 'F') AS finished FROM d LEFT JOIN rec USING (size_class) GROUP BY size_class""",
    "q_object_recall": f"WITH {RECALLED} SELECT id, area, size_class, instances, matched_instances, detected, coalesce(max_conf, -1.0) AS max_conf FROM rec",
    "q_size_recall": f"""WITH {RECALLED}, a AS (SELECT size_class, detected FROM rec UNION ALL SELECT 'overall', detected FROM rec)
SELECT size_class, count(*) AS objects, count(*) FILTER (detected) AS detected, count(*) FILTER (NOT detected) AS missed, round(avg(detected::INTEGER), 6) AS recall FROM a GROUP BY size_class""",
    "q_quartile_table": f"""WITH {I.OBJECTS}, t AS (SELECT 'all' AS dataset, area FROM obj UNION ALL SELECT 'finished', area FROM obj WHERE status = 'F'), p AS (SELECT * FROM (VALUES ('Q1', 0.25), ('median', 0.5), ('Q3', 0.75)) v(quantile, share))
SELECT dataset, quantile, CASE quantile WHEN 'Q1' THEN quantile_cont(area, 0.25) WHEN 'median' THEN quantile_cont(area, 0.5) ELSE quantile_cont(area, 0.75) END AS value FROM t, p GROUP BY dataset, quantile""",
    "q_thirds": f"WITH {THIRD} SELECT third, count(*) AS objects, count(*) FILTER (detected) AS detected, round(avg(detected::INTEGER), 6) AS recall FROM thirds GROUP BY third",
    "q_thirds_size": f"""WITH {THIRD}, d AS (SELECT * FROM (SELECT unnest(['west', 'middle', 'east']) AS third), (SELECT unnest(['small', 'medium', 'large', 'huge']) AS size_class))
SELECT d.third, d.size_class, count(t.id) AS objects, count(t.id) FILTER (detected) AS detected, coalesce(round(count(t.id) FILTER (detected) / nullif(count(t.id), 0)::DOUBLE, 6), -1.0) AS recall
FROM d LEFT JOIN thirds t ON t.third = d.third AND t.size_class = d.size_class GROUP BY d.third, d.size_class""",
    "q_location": f"WITH {THIRD} SELECT CASE WHEN detected THEN 'detected' ELSE 'missed' END AS status, count(*) AS objects, round(avg(distance_km), 6) AS mean_km, round(median(distance_km), 6) AS median_km, round(avg(relative), 6) AS mean_relative FROM thirds GROUP BY 1",
    "q_crosstab": f"WITH {THIRD} SELECT third, count(*) FILTER (size_class = 'small') AS n_small, count(*) FILTER (size_class = 'medium') AS n_medium, count(*) FILTER (size_class = 'large') AS n_large FROM thirds GROUP BY third",
    "q_bands": f"WITH {RECALLED} SELECT least(5, floor(y0 / 8000)::BIGINT + 1) AS band, count(*) AS objects, count(*) FILTER (detected) AS detected, round(avg(detected::INTEGER), 6) AS recall FROM rec GROUP BY 1",
    "q_grid_corr": f"""WITH {RECALLED}, n AS (SELECT least(9, floor(x0 / 10000))::BIGINT AS gx, least(9, floor(y0 / 4000))::BIGINT AS gy, count(*) AS n, count(*) FILTER (detected) AS d FROM rec GROUP BY 1, 2),
g AS (SELECT gx, gy FROM (SELECT unnest(range(10)) AS gx), (SELECT unnest(range(10)) AS gy))
SELECT count(*) AS cells, sum(coalesce(n, 0))::BIGINT AS objects, round(corr(coalesce(n, 0), coalesce(d, 0)), 6) AS r FROM g LEFT JOIN n USING (gx, gy)""",
    "q_agreement": f"""WITH {I.DETECTIONS}, {I.OBJECTS}, p AS (SELECT x0 % 2048 AS px, y0 % 2048 AS py FROM obj),
hit AS (SELECT DISTINCT d.id FROM det d JOIN p ON d.x0 <= px AND px <= d.x1 AND d.y0 <= py AND py <= d.y1),
t AS (SELECT CASE WHEN conf >= 50 THEN 'yes' ELSE 'no' END AS label, h.id IS NOT NULL AS site FROM det d LEFT JOIN hit h ON h.id = d.id)
SELECT label, count(*) FILTER (site) AS site_inside, count(*) FILTER (NOT site) AS no_site, round(count(*) FILTER (site) / count(*)::DOUBLE, 6) AS site_share FROM t GROUP BY label""",
    "q_tiles": f"WITH {I.TILES} SELECT tile_name, split, row_start, col_start, x0, y0, x1, y1, row_number() OVER (PARTITION BY split ORDER BY row_start, col_start) - 1 AS tile_number FROM tiles",
    "q_tile_label": f"""WITH {SEEN}, {LAB}
SELECT tile_name, row_number() OVER (PARTITION BY tile_name ORDER BY id) - 1 AS label_index, id, ((cx0 + cx1) / 2 - x0) / (x1 - x0) AS x_center, (y1 - (cy0 + cy1) / 2) / (y1 - y0) AS y_center, (cx1 - cx0) / (x1 - x0) AS width, (cy1 - cy0) / (y1 - y0) AS height FROM lab""",
    "q_tile_summary": f"WITH {SEEN}, {LAB}, {SUMMARY} SELECT * FROM summ",
    "q_coverage": f"WITH {SEEN}, {LAB}, {COVER} SELECT * FROM cov",
    "q_contamination": f"""WITH {FINE_SEEN},
f AS (SELECT tile_name, count(*) FILTER (split = osplit AND visible >= 0.5) AS labelable, count(*) FILTER (split = osplit AND visible < 0.5) AS part, count(*) FILTER (split <> osplit AND osplit <> 'exclude_boundary') AS other,
  count(*) FILTER (osplit = 'exclude_boundary') AS bound, max(visible) AS most, string_agg(CASE WHEN split = osplit AND visible < 0.5 THEN id::VARCHAR END, ';' ORDER BY id) AS ids FROM seen GROUP BY tile_name),
b AS (SELECT split, coalesce(part, 0) AS part, coalesce(other, 0) AS other, coalesce(bound, 0) AS bound, coalesce(most, 0.0) AS most, coalesce(ids, '') AS ids FROM tiles LEFT JOIN f USING (tile_name) WHERE coalesce(labelable, 0) = 0),
a AS (SELECT * FROM b UNION ALL SELECT 'ALL', part, other, bound, most, ids FROM b)
SELECT split, count(*) AS background_tiles, count(*) FILTER (part > 0) AS partial_tiles, count(*) FILTER (other > 0) AS cross_split_tiles, count(*) FILTER (bound > 0) AS boundary_tiles, count(*) FILTER (part + other + bound > 0) AS any_tiles,
  round(max(most), 6) AS max_visible, max(ids) AS last_partial_ids, round(100.0 * count(*) FILTER (part + other + bound > 0) / count(*)::DOUBLE, 6) AS any_percent FROM a GROUP BY split""",
    "q_hidden_positive": f"""WITH {FINE_SEEN}, f AS (SELECT tile_name, count(*) FILTER (visible >= 0.5) AS labelled, count(*) FILTER (visible < 0.5) AS part FROM seen WHERE split = osplit GROUP BY tile_name),
h AS (SELECT split, coalesce(labelled, 0) = 0 AND coalesce(part, 0) > 0 AS hidden, col_start % 2 = 0 AS saved FROM tiles LEFT JOIN f USING (tile_name))
SELECT split, count(*) AS tiles, count(*) FILTER (hidden) AS hidden, count(*) FILTER (hidden AND saved) AS hidden_saved, count(*) FILTER (NOT hidden AND NOT saved) AS unsaved FROM h GROUP BY split""",
    "q_aoi": f"""WITH {I.OBJECTS}, a AS (SELECT 20000.0::DOUBLE AS x0, 10000.0::DOUBLE AS y0, 60040.0::DOUBLE AS x1, 30040.0::DOUBLE AS y1),
s AS (SELECT o.*, {I.inter("o", "a")} / {I.area("o")} AS share, o.x0 <= a.x1 AND a.x0 <= o.x1 AND o.y0 <= a.y1 AND a.y0 <= o.y1 AS meets,
  a.x0 <= (o.x0 + o.x1) / 2 AND (o.x0 + o.x1) / 2 <= a.x1 AND a.y0 <= (o.y0 + o.y1) / 2 AND (o.y0 + o.y1) / 2 <= a.y1 AS mid, a.x0 <= o.x0 AND a.y0 <= o.y0 AND o.x1 <= a.x1 AND o.y1 <= a.y1 AS whole FROM obj o, a)
SELECT count(*) FILTER (meets) AS intersects, count(*) FILTER (mid) AS centre_inside, count(*) FILTER (share >= 0.5) AS half_inside, count(*) FILTER (whole) AS fully_inside, count(*) FILTER (NOT meets) AS outside, count(*) AS n,
  round(avg(share), 6) AS mean, round(stddev_samp(share), 6) AS sd, min(share) AS least, max(share) AS most, round(quantile_cont(share, 0.25), 6) AS q1, round(quantile_cont(share, 0.5), 6) AS q2, round(quantile_cont(share, 0.75), 6) AS q3 FROM s""",
    "q_clean_pool": f"""WITH {I.OBJECTS}, h AS (SELECT i, ('0x' || substr(md5('42/1/' || i), 1, 8))::BIGINT % {I.HEIGHT - MINED + 1} AS row_start, ('0x' || substr(md5('42/2/' || i), 1, 8))::BIGINT % {I.WIDTH - MINED + 1} AS col_start FROM range({TRIES}) t(i)),
b AS (SELECT min(i) AS attempt, row_start, col_start, {I.LEFT} + col_start * {I.RESOLUTION}::DOUBLE AS x0, {I.TOP} - (row_start + {MINED}) * {I.RESOLUTION}::DOUBLE AS y0, {I.LEFT} + (col_start + {MINED}) * {I.RESOLUTION}::DOUBLE AS x1, {I.TOP} - row_start * {I.RESOLUTION}::DOUBLE AS y1 FROM h GROUP BY row_start, col_start),
hit AS (SELECT DISTINCT b.attempt FROM b JOIN obj o ON o.x0 <= b.x1 AND b.x0 <= o.x1 AND o.y0 <= b.y1 AND b.y0 <= o.y1 WHERE b.x1 <= {I.FIRST})
SELECT attempt, row_start, col_start FROM b WHERE x1 <= {I.FIRST} AND attempt NOT IN (SELECT attempt FROM hit) ORDER BY attempt LIMIT {POOL}""",
    "q_sample": f"""WITH {RECALLED}, s AS (SELECT concat_ws('/', size_class, detected::VARCHAR) AS stratum, id, detected FROM rec),
n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42/' || id), id) AS n FROM s)
SELECT stratum, id FROM n WHERE n <= CASE WHEN detected THEN 4 ELSE 2 END""",
    "q_dataset_check": f"WITH {SEEN}, {LAB}, {SUMMARY}, {COVER} SELECT split, tiles, labels, assigned, covered, missing FROM summ JOIN cov USING (split)",
}
