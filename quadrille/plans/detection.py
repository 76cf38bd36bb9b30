"""Queries over detections: matching, duplicates, suppression, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrille.functions import boxes as B
from quadrille.operators import grouping, matching, selection, spatial, suppress
from quadrille.plans import inputs as I
from quadrille.sources.shared import written

LEAST, CELL = 0.5, 64.0


def told(spark, sf):
    return matching.outcomes(I.detections(spark, sf), I.truths(spark, sf), least=LEAST, cell=CELL)


def q_pr(spark, sf):
    return matching.precision_recall(told(spark, sf), I.truths(spark, sf))


def q_match(spark, sf):
    return told(spark, sf).select("id", "tile", "status", F.coalesce("gid", F.lit(-1)).alias("gid"), F.round("best_iou", 6).alias("best_iou"))


def q_ap(spark, sf):
    return matching.average_precision(told(spark, sf), I.truths(spark, sf))


def q_map(spark, sf):
    """Average precision at overlaps from 0.5 to 0.95, and their mean."""
    return matching.mean_average_precision(I.detections(spark, sf), I.truths(spark, sf), cell=CELL)


def q_dup_pairs(spark, sf):
    counts = written(spatial.overlap_counts(I.detections(spark, sf), cell=CELL), "overlaps")
    end = F.sum("n").over(Window.orderBy("iou"))  # at most a million values, of six digits
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.min("iou").alias("min_iou"), F.max("iou").alias("max_iou"))
    value_at = lambda rank: F.min(F.when(F.col("end") > F.floor(rank), F.col("iou")))
    placed = counts.withColumn("end", end).crossJoin(F.broadcast(total.select("pairs")))
    middle = placed.agg(((value_at((F.col("pairs") - 1) / 2) + value_at(F.col("pairs") / 2)) / 2).alias("median_iou"))
    return total.crossJoin(F.broadcast(middle)).select("pairs", "min_iou", "max_iou", "median_iou")


def q_nms(spark, sf):
    return suppress.nms(I.detections(spark, sf), least=0.3, cell=CELL).select("id", "tile", "conf")


def q_lineage(spark, sf):
    links = suppress.lineage(I.detections(spark, sf), least=0.3, cell=CELL)
    return links.select("id", "kept_id", F.round("iou", 6).alias("iou"))


def q_candidates(spark, sf):
    d = I.detections(spark, sf)
    return suppress.candidates(d, suppress.lineage(d, least=0.3, cell=CELL)).withColumn("advisor_label", F.lit(""))


def q_nms_sweep(spark, sf):
    return suppress.sweep(I.detections(spark, sf), [0.3, 0.4, 0.5, 0.6, 0.7], cell=CELL)


def windows(spark, sf):
    """Detections as windows of 64 x 64 for the selection of diverse ones."""
    return I.detections(spark, sf).select("id", "x0", "y0", (F.col("x0") + 64).alias("x1"), (F.col("y0") + 64).alias("y1"), "conf")


def q_diverse(spark, sf):
    found = suppress.diverse(windows(spark, sf), 30, most=0.25, tile_area=4096.0)
    return found.select(F.col("rank").cast("long").alias("rank"), "id", "conf", "max_overlap")


def q_refill(spark, sf):
    """A selection of 30 of which the five windows of the smallest ids are chosen already."""
    w = windows(spark, sf)
    found = suppress.diverse(w, 30, most=0.25, tile_area=4096.0, seeds=w.orderBy("id").limit(5))
    return found.select(F.col("rank").cast("long").alias("rank"), "id", "conf", "max_overlap")


def q_threshold_sweep(spark, sf):
    d = I.detections(spark, sf)
    cuts = [0.05, 0.1, 0.25, 0.5]
    top = d.agg(F.max("conf").alias("top"))
    n = d.crossJoin(F.broadcast(top)).agg(*(F.count_if(F.col("conf") >= F.lit(t) * F.col("top")).alias(f"n{i}") for i, t in enumerate(cuts)), F.count("*").alias("raw"))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n")) for i, t in enumerate(cuts)))
    return n.select(F.explode(rows).alias("r"), "raw").select("r.threshold", "r.n", "raw")


def q_tile_scores(spark, sf):
    d = I.detections(spark, sf).withColumn("cell", F.floor(F.col("x0") / 256).cast("bigint"))
    n = d.groupBy("cell").agg(F.count("*").alias("n"), *(F.count_if(F.col("conf") >= c).alias(f"n_{c}") for c in (5, 25, 50, 100)), F.max("conf").alias("max_conf"))
    every = spark.range(40).select(F.col("id").alias("cell"))
    return every.join(n, "cell", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n_5", "n_25", "n_50", "n_100")}).withColumn("max_conf", F.coalesce("max_conf", F.lit(0.0)))


def q_topk(spark, sf):
    """The twelve detections of the highest confidence in each tile."""
    return selection.top(I.detections(spark, sf), 12, [F.col("conf").desc_nulls_last(), F.col("id")], ["tile"]).select("tile", "id", "conf", "x0", "y0")


def q_pages(spark, sf):
    """The first five pages of ten in each tile."""
    order = [F.col("conf").desc_nulls_last(), F.col("id")]
    d = selection.top(I.detections(spark, sf), 50, order, ["tile"])
    return selection.paged(d, 10, order, ["tile"]).select("tile", "id", "page", F.col("place").cast("long").alias("place"))


def q_georef(spark, sf):
    """Detections in map coordinates of their tile, from a table of tiles that must not repeat one."""
    from quadrille.operators import audit

    tiles = spark.range(8).select(F.col("id").alias("tile"), (F.col("id") * 3200.0).alias("left"), (40_000.0 - F.col("id") * 100.0).alias("top"))
    d = audit.lookup(I.detections(spark, sf), tiles, ["tile"])
    m = B.pixel_to_map(B.box(), F.col("left"), F.col("top"), 10.0)
    named = d.select("id", *(c.alias(n) for c, n in zip(m, ("map_x0", "map_y0", "map_x1", "map_y1"), strict=True)))
    return named.withColumns({"width_m": F.col("map_x1") - F.col("map_x0"), "height_m": F.col("map_y1") - F.col("map_y0")}).withColumn("box_area_m2", F.col("width_m") * F.col("height_m"))


def q_positional(spark, sf):
    """The n-th truth of a tile joined with its n-th detection that matched, and tiles whose counts differ."""
    from pyspark.sql import Window

    nth = lambda f: f.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("id")))
    cell = F.floor(F.col("x0") / 64).cast("bigint")
    a = nth(I.detections(spark, sf).where("id % 3 <> 0").withColumn("cell", cell)).select("cell", "n", F.col("id").alias("instance_id"))
    b = nth(I.truths(spark, sf).withColumn("cell", F.floor((F.col("x0") - F.col("id") % 11) / 64).cast("bigint"))).select("cell", "n", F.col("id").alias("truth_id"))
    joined = a.join(b, ["cell", "n"], "full_outer")
    return joined.groupBy("cell").agg(F.count("instance_id").alias("instances"), F.count("truth_id").alias("truths"), F.count_if(F.col("instance_id") != F.col("truth_id")).alias("differing"), (F.count("instance_id") == F.count("truth_id")).alias("consistent"))


def q_size_quartile(spark, sf):
    """Truths by quartile of their area, and how many of each were found."""
    t = I.truths(spark, sf)
    found = told(spark, sf).where("status = 'true_positive'").select(F.col("gid").alias("id"), F.lit(True).alias("found"))
    sized = t.select("id", (F.col("x1") - F.col("x0")).alias("width"), B.area(B.box()).alias("area"))
    q = grouping.quantiles(sized, F.col("area"), [0.25, 0.5, 0.75])
    bounds = [F.col("q")[i] for i in range(3)]
    grouped = sized.crossJoin(F.broadcast(q)).withColumn("size_group", grouping.by_bounds(F.col("area"), bounds, ["Q1", "Q2", "Q3", "Q4"], right_closed=True)).join(found, "id", "left")
    out = grouped.groupBy("size_group").agg(F.count("*").alias("labelled"), F.count_if("found").alias("detected"), F.round(F.avg("width"), 6).alias("mean_width"), F.round(F.avg("area"), 6).alias("mean_area"))
    return out.withColumn("recall", F.round(B.ratio(F.col("detected").cast("double"), F.col("labelled").cast("double")), 6))


QUERIES = {f.__name__: f for f in (q_pr, q_match, q_ap, q_map, q_dup_pairs, q_nms, q_lineage, q_candidates, q_nms_sweep, q_diverse, q_refill, q_threshold_sweep, q_tile_scores, q_topk, q_pages, q_georef, q_positional, q_size_quartile)}

D, T = I.DETECTIONS, I.TRUTHS

PAIRS = f"""WITH RECURSIVE {D}, {T},
pairs AS MATERIALIZED (SELECT d.tile, d.id AS pid, d.conf, g.id AS gid, {I.iou("d", "g")} AS iou FROM det d JOIN gt g ON d.tile = g.tile AND {I.apart("d", "g")}),
"""


def taken_sql(least: float, s: str = "s", r: str = "r", taken: str = "taken") -> str:
    """The edges that a greedy scan takes, by a recursion over the edges of each tile in their order."""
    return f"""{s} AS MATERIALIZED (SELECT tile, pid, gid, row_number() OVER (PARTITION BY tile ORDER BY conf DESC NULLS LAST, pid, iou DESC, gid) AS k FROM pairs WHERE iou >= {least}),
{r}(tile, k, up, ug) AS (
  SELECT tile, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM {s} GROUP BY tile
  UNION ALL
  SELECT {r}.tile, {s}.k,
    CASE WHEN list_contains(up, {s}.pid) OR list_contains(ug, {s}.gid) THEN up ELSE list_append(up, {s}.pid) END,
    CASE WHEN list_contains(up, {s}.pid) OR list_contains(ug, {s}.gid) THEN ug ELSE list_append(ug, {s}.gid) END
  FROM {r} JOIN {s} ON {s}.tile = {r}.tile AND {s}.k = {r}.k + 1
),
{taken} AS MATERIALIZED (SELECT unnest(up) AS pid, unnest(ug) AS gid FROM (SELECT arg_max(up, k) AS up, arg_max(ug, k) AS ug FROM {r} GROUP BY tile))"""


MATCHED = f"""{PAIRS}{taken_sql(LEAST)},
by_truth AS (SELECT t.gid, t.pid, d.conf FROM taken t JOIN det d ON d.id = t.pid),
best AS (
  SELECT p.pid, max(p.iou) AS iou FROM pairs p LEFT JOIN by_truth b ON b.gid = p.gid
  WHERE b.pid IS NULL OR NOT coalesce(b.conf > p.conf OR (b.conf = p.conf AND b.pid < p.pid), false) GROUP BY p.pid
),
told AS (
  SELECT d.id, d.tile, d.conf, CASE WHEN t.gid IS NOT NULL THEN 'true_positive' ELSE 'false_positive' END AS status, t.gid, coalesce(p.iou, b.iou, 0.0) AS best_iou
  FROM det d LEFT JOIN taken t ON t.pid = d.id LEFT JOIN pairs p ON p.pid = t.pid AND p.gid = t.gid LEFT JOIN best b ON b.pid = d.id
)"""

SUPPRESSED = f"""WITH RECURSIVE {D},
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY conf DESC NULLS LAST, id) AS rk FROM det),
con AS MATERIALIZED (SELECT a.rk AS hi, b.rk AS lo, {I.iou("a", "b")} AS value FROM ranked a JOIN ranked b ON a.rk < b.rk AND a.tile <> b.tile AND {I.apart("a", "b")} WHERE {I.iou("a", "b")} >= 0.3),
"""


def suppressed_sql(name: str, least: float) -> str:
    """A recursion over the lower ends of conflicts by rank, with the list of those that are suppressed."""
    return f"""lows_{name} AS MATERIALIZED (SELECT lo, list(hi) AS his, row_number() OVER (ORDER BY lo) AS k FROM con WHERE value >= {least} GROUP BY lo),
rec_{name}(k, gone) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT n.k, CASE WHEN len(list_filter(n.his, lambda x: NOT list_contains(r.gone, x))) > 0 THEN list_append(r.gone, n.lo) ELSE r.gone END
  FROM rec_{name} r JOIN lows_{name} n ON n.k = r.k + 1
),
gone_{name} AS MATERIALIZED (SELECT unnest(gone) AS rk FROM (SELECT arg_max(gone, k) AS gone FROM rec_{name}))"""


LINEAGE = f"""{SUPPRESSED}{suppressed_sql("a", 0.3)},
links AS (
  SELECT lo.id, min(c.hi) AS hi, arg_min(c.value, c.hi) AS value
  FROM con c JOIN gone_a g ON g.rk = c.lo JOIN ranked lo ON lo.rk = c.lo
  WHERE c.hi NOT IN (SELECT rk FROM gone_a) GROUP BY lo.id
),
named AS (SELECT l.id, r.id AS kept_id, l.value AS iou FROM links l JOIN ranked r ON r.rk = l.hi)"""

WINDOWS = f"""WITH RECURSIVE {D}, w AS (SELECT id, x0, y0, x0 + 64 AS x1, y0 + 64 AS y1, conf FROM det)"""

DIVERSE = """con AS MATERIALIZED (SELECT a.rk AS hi, b.rk AS lo, 1.0 AS value FROM ranked a JOIN ranked b ON a.rk < b.rk AND {apart} WHERE {inter} / 4096.0 > 0.25),
""".format(apart=I.apart("a", "b"), inter=I.inter("a", "b"))

ORACLES = {
    "q_pr": f"""{MATCHED}
SELECT n.predictions, t.truths, n.tp AS true_positives, n.predictions - n.tp AS false_positives, t.truths - n.tp AS false_negatives,
  coalesce(n.tp::DOUBLE / nullif(n.predictions, 0), 0.0) AS precision, coalesce(n.tp::DOUBLE / nullif(t.truths, 0), 0.0) AS recall
FROM (SELECT count(*) AS predictions, count(*) FILTER (status = 'true_positive') AS tp FROM told) n, (SELECT count(*) AS truths FROM gt) t""",
    "q_match": f"{MATCHED} SELECT id, tile, status, coalesce(gid, -1) AS gid, round(best_iou, 6) AS best_iou FROM told",
    "q_ap": f"""{MATCHED},
run AS (SELECT *, sum(CASE WHEN status = 'true_positive' THEN 1 ELSE 0 END) OVER o AS tp, row_number() OVER o AS n FROM told WINDOW o AS (ORDER BY conf DESC NULLS LAST, id)),
env AS (SELECT *, max(tp::DOUBLE / n) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM run)
SELECT count(*) AS true_positives, (SELECT count(*) FROM gt) AS truths, round(coalesce(sum(best), 0.0) / (SELECT count(*) FROM gt), 6) AS average_precision FROM env WHERE status = 'true_positive'""",
    "q_map": PAIRS
    + ", ".join(taken_sql(t, f"s{i}", f"r{i}", f"taken{i}") for i, t in enumerate(matching.THRESHOLDS))
    + ", hits AS ("
    + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS t, pid FROM taken{i}" for i, t in enumerate(matching.THRESHOLDS))
    + f"""), every AS (SELECT unnest([{", ".join(map(str, matching.THRESHOLDS))}])::DOUBLE AS t),
told AS (SELECT e.t, d.id, d.conf, h.pid IS NOT NULL AS hit FROM every e CROSS JOIN det d LEFT JOIN hits h ON h.t = e.t AND h.pid = d.id),
run AS (SELECT *, sum(hit::INTEGER) OVER o AS tp, row_number() OVER o AS n FROM told WINDOW o AS (PARTITION BY t ORDER BY conf DESC NULLS LAST, id)),
env AS (SELECT *, max(tp::DOUBLE / n) OVER (PARTITION BY t ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM run),
ap AS (SELECT t AS iou_threshold, count(*) FILTER (hit) AS true_positives, (SELECT count(*) FROM gt) AS truths, round(coalesce(sum(best) FILTER (hit), 0.0) / (SELECT count(*) FROM gt), 6) AS average_precision FROM env GROUP BY t)
SELECT *, round(avg(average_precision) OVER (), 6) AS mean_ap FROM ap""",
    "q_dup_pairs": f"""WITH {D}, p AS (SELECT round({I.iou("a", "b")}, 6) AS iou FROM det a JOIN det b ON a.id < b.id AND a.tile <> b.tile AND {I.apart("a", "b")})
SELECT count(*) AS pairs, min(iou) AS min_iou, median(iou) AS median_iou, max(iou) AS max_iou FROM p WHERE iou > 0""",
    "q_nms": f"{SUPPRESSED}{suppressed_sql('a', 0.3)} SELECT id, tile, conf FROM ranked WHERE rk NOT IN (SELECT rk FROM gone_a)",
    "q_lineage": f"{LINEAGE} SELECT id, kept_id, round(iou, 6) AS iou FROM named",
    "q_candidates": f"""{LINEAGE}, n AS (SELECT kept_id, count(*) AS n FROM named GROUP BY kept_id)
SELECT r.id, r.tile, r.conf, 'C' || lpad((row_number() OVER (ORDER BY r.conf DESC NULLS LAST, r.id))::VARCHAR, 4, '0') AS candidate_id, 1 + coalesce(n.n, 0) AS source_detection_count, '' AS advisor_label
FROM ranked r LEFT JOIN n ON n.kept_id = r.id WHERE r.id NOT IN (SELECT id FROM named)""",
    "q_nms_sweep": SUPPRESSED
    + ", ".join(suppressed_sql(f"t{i}", t) for i, t in enumerate((0.3, 0.4, 0.5, 0.6, 0.7)))
    + ", n AS (SELECT count(*) AS raw FROM det), c AS ("
    + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS iou_threshold, (SELECT count(*) FROM gone_t{i}) AS suppressed" for i, t in enumerate((0.3, 0.4, 0.5, 0.6, 0.7)))
    + ") SELECT iou_threshold, raw, raw - suppressed AS kept, suppressed, round(100.0 * suppressed / raw::DOUBLE, 6) AS percent_suppressed FROM c, n",
    "q_diverse": f"""{WINDOWS}, ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY conf DESC NULLS LAST, id) AS rk FROM w), {DIVERSE}{suppressed_sql("a", 0)},
t AS (SELECT row_number() OVER (ORDER BY rk) AS rank, * FROM ranked WHERE rk NOT IN (SELECT rk FROM gone_a) ORDER BY rk LIMIT 30)
SELECT a.rank, a.id, a.conf, coalesce(max({I.inter("a", "b")} / 4096.0::DOUBLE) FILTER (b.rank IS NOT NULL), 0.0) AS max_overlap FROM t a LEFT JOIN t b ON b.rank < a.rank GROUP BY a.rank, a.id, a.conf""",
    "q_refill": f"""{WINDOWS}, seeds AS (SELECT * FROM w ORDER BY id LIMIT 5),
free AS (SELECT * FROM w a WHERE id NOT IN (SELECT id FROM seeds) AND NOT EXISTS (SELECT 1 FROM seeds b WHERE {I.inter("a", "b")} / 4096.0 > 0.25)),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY conf DESC NULLS LAST, id) AS rk FROM free), {DIVERSE}{suppressed_sql("a", 0)},
t AS (SELECT row_number() OVER (ORDER BY rk) AS rank, * FROM ranked WHERE rk NOT IN (SELECT rk FROM gone_a) ORDER BY rk LIMIT (SELECT 30 - count(*) FROM seeds)),
u AS (SELECT rank, x0, y0, x1, y1 FROM t UNION ALL SELECT 0, x0, y0, x1, y1 FROM seeds)
SELECT a.rank, a.id, a.conf, coalesce(max({I.inter("a", "b")} / 4096.0::DOUBLE) FILTER (b.rank IS NOT NULL), 0.0) AS max_overlap FROM t a LEFT JOIN u b ON b.rank < a.rank GROUP BY a.rank, a.id, a.conf""",
    "q_threshold_sweep": f"""WITH {D}, m AS (SELECT max(conf) AS top, count(*) AS raw FROM det), t AS (SELECT unnest([0.05, 0.1, 0.25, 0.5])::DOUBLE AS threshold)
SELECT threshold, count(*) FILTER (conf >= threshold * top) AS n, any_value(raw) AS raw FROM det, m, t GROUP BY threshold""",
    "q_tile_scores": f"""WITH {D}, n AS (SELECT floor(x0 / 256)::BIGINT AS cell, count(*) AS n, count(*) FILTER (conf >= 5) AS n_5, count(*) FILTER (conf >= 25) AS n_25, count(*) FILTER (conf >= 50) AS n_50, count(*) FILTER (conf >= 100) AS n_100, max(conf) AS max_conf FROM det GROUP BY 1)
SELECT c.cell, coalesce(n, 0) AS n, coalesce(n_5, 0) AS n_5, coalesce(n_25, 0) AS n_25, coalesce(n_50, 0) AS n_50, coalesce(n_100, 0) AS n_100, coalesce(max_conf, 0.0) AS max_conf FROM (SELECT unnest(range(40)) AS cell) c LEFT JOIN n USING (cell)""",
    "q_topk": f"WITH {D}, t AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY conf DESC NULLS LAST, id) AS n FROM det) SELECT tile, id, conf, x0, y0 FROM t WHERE n <= 12",
    "q_pages": f"""WITH {D}, t AS (SELECT tile, id, row_number() OVER (PARTITION BY tile ORDER BY conf DESC NULLS LAST, id) - 1 AS n FROM det)
SELECT tile, id, n // 10 AS page, n % 10 AS place FROM t WHERE n < 50""",
    "q_georef": f"""WITH {D}, m AS (SELECT id, tile * 3200.0::DOUBLE + x0 * 10 AS map_x0, 40000.0::DOUBLE - tile * 100.0::DOUBLE - y1 * 10 AS map_y0, tile * 3200.0::DOUBLE + x1 * 10 AS map_x1, 40000.0::DOUBLE - tile * 100.0::DOUBLE - y0 * 10 AS map_y1 FROM det)
SELECT *, map_x1 - map_x0 AS width_m, map_y1 - map_y0 AS height_m, (map_x1 - map_x0) * (map_y1 - map_y0) AS box_area_m2 FROM m""",
    "q_positional": f"""WITH {D}, {T},
a AS (SELECT floor(x0 / 64)::BIGINT AS cell, id, row_number() OVER (PARTITION BY floor(x0 / 64) ORDER BY id) AS n FROM det WHERE id % 3 <> 0),
b AS (SELECT floor((x0 - id % 11) / 64)::BIGINT AS cell, id, row_number() OVER (PARTITION BY floor((x0 - id % 11) / 64) ORDER BY id) AS n FROM gt)
SELECT cell, count(a.id) AS instances, count(b.id) AS truths, count(*) FILTER (a.id <> b.id) AS differing, count(a.id) = count(b.id) AS consistent FROM a FULL JOIN b USING (cell, n) GROUP BY cell""",
    "q_size_quartile": f"""{MATCHED},
sized AS (SELECT g.id, x1 - x0 AS width, {I.area("g")} AS area, t.gid IS NOT NULL AS found FROM gt g LEFT JOIN taken t ON t.gid = g.id),
q AS (SELECT quantile_cont(area, 0.25) AS q1, quantile_cont(area, 0.5) AS q2, quantile_cont(area, 0.75) AS q3 FROM sized)
SELECT CASE WHEN area <= q1 THEN 'Q1' WHEN area <= q2 THEN 'Q2' WHEN area <= q3 THEN 'Q3' ELSE 'Q4' END AS size_group, count(*) AS labelled, count(*) FILTER (found) AS detected,
  round(avg(width), 6) AS mean_width, round(avg(area), 6) AS mean_area, round(count(*) FILTER (found) / count(*)::DOUBLE, 6) AS recall FROM sized, q GROUP BY 1""",
}
