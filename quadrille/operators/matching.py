"""Greedy matching of detections to truths.

Detections in order of confidence each take the free truth of the highest overlap. A task scans a tile of up to
SCENE_ROWS boxes so and makes no table of pairs. In larger tiles edges are taken in one total order whenever both ends
are free, which comes to the same: an edge is taken for certain once it comes first at both of its ends. A round takes
all such edges and drops those that share an end with one; the rounds end when few enough edges are left for one task,
which scans them in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quadrille.functions import boxes as B
from quadrille.operators import scans
from quadrille.operators.spatial import overlap_pairs
from quadrille.sources.shared import drop_written, written


#: Open edges that one task scans; more are decided in rounds.
TAIL_ROWS = 2_000_000


def edges(detections: DataFrame, truths: DataFrame, *, cell: float) -> DataFrame:
    """Overlapping pairs within a tile: tile, pid, conf, gid, iou."""
    pairs = overlap_pairs(detections, truths, cell=cell, also=F.col("l_tile") == F.col("r_tile"))
    return pairs.select(F.col("l_tile").alias("tile"), F.col("l_id").alias("pid"), F.col("l_conf").alias("conf"), F.col("r_id").alias("gid"), B.iou(B.box("l_"), B.box("r_")).alias("iou"))


def greedy(pairs: DataFrame, least: float, by: str | None = None) -> DataFrame:
    """The edges of at least that overlap which a greedy scan takes: tile, pid, conf, gid, iou and by.

    Order: confidence falling, pid, overlap falling, gid; null confidence last. Ids are unique over all tiles; by names
    a column whose values are scenes of their own. A round is one job, with one window an end; it writes the edges it
    takes and those that stay open, until at most TAIL_ROWS are, which a task a scene scans in order. No tile is
    gathered into a row.
    """
    keys = [by] if by else []
    left = written(pairs.where(F.col("iou") >= least), "match-edges")
    columns, out = left.columns, left.limit(0)
    order = [F.col("conf").desc_nulls_last(), F.col("pid"), F.col("iou").desc(), F.col("gid")]
    while left.count() > TAIL_ROWS:
        first = lambda end: F.row_number().over(Window.partitionBy(*keys, end).orderBy(*order)) == 1
        flagged = left.withColumn("_p", first("pid")).withColumn("_g", first("gid")).withColumn("_taken", F.col("_p") & F.col("_g")).drop("_p", "_g")
        took = lambda end: F.max("_taken").over(Window.partitionBy(*keys, end))
        told = flagged.withColumn("_pid", took("pid")).withColumn("_gid", took("gid"))
        after = written(told.where(F.col("_taken") | ~(F.col("_pid") | F.col("_gid"))).select(*columns, "_taken"), "match-edges")
        out = out.unionAll(after.where("_taken").select(columns))
        left = after.where("NOT _taken").select(columns)
    scene = F.col(by) if by else F.lit(0)
    placed = left.withColumn("_scene", scene).withColumn("_n", F.row_number().over(Window.partitionBy("_scene").orderBy(*order)))
    return out.unionAll(placed.groupBy("_scene").applyInArrow(_scanned, placed.schema).select(columns))


def _scanned(edges: pa.Table) -> pa.Table:
    """The edges whose ends are both free when a scan by _n comes to them."""
    edges = edges.sort_by("_n")
    pids, gids, taken = set(), set(), []
    for pid, gid in zip(edges["pid"].to_pylist(), edges["gid"].to_pylist(), strict=True):
        taken.append(pid not in pids and gid not in gids)
        if taken[-1]:
            pids.add(pid)
            gids.add(gid)
    return edges.filter(pa.array(taken, pa.bool_()))


#: Boxes of a scene, detections and truths, that one task scans; larger scenes are matched by joins and rounds.
SCENE_ROWS = 2_000_000

_CORNERS = ("x0", "y0", "x1", "y1")


def _scenes(detections: DataFrame, truths: DataFrame) -> tuple[DataFrame, list]:
    """Rows of both sides for a scan a tile, and the tiles that are too large for one."""
    corner = [F.col(c).cast("double").alias(c) for c in _CORNERS]
    d = detections.select("tile", "id", F.col("conf").cast("double").alias("conf"), *corner, F.lit(False).alias("truth"))
    both = d.unionAll(truths.select("tile", "id", F.lit(None).cast("double").alias("conf"), *corner, F.lit(True).alias("truth")))
    large = both.groupBy("tile").agg(F.count("*").alias("n")).where((F.col("n") > SCENE_ROWS) & F.col("tile").isNotNull()).collect()
    return both, [r.tile for r in large]


def _arrays(scene: pa.Table) -> tuple:
    """Boxes, ids, detections in their order, usable truths, and the order's flags of null confidence."""
    column = lambda c: scene[c].to_numpy()
    boxes = np.stack([scene[c].cast(pa.float64()).to_numpy() for c in _CORNERS])
    ids, truth = column("id"), column("truth")
    known, none = np.zeros(len(ids), bool), not scene["tile"][0].is_valid
    if not none:
        known[scans.usable(boxes)] = True
    missing = scene["conf"].is_null().to_numpy()
    rows = np.nonzero(~truth)[0]
    rows = rows[scans.in_order(scene["conf"].to_numpy()[rows], missing[rows], ids[rows])]
    return boxes, ids, rows, known, np.nonzero(truth & known)[0], missing


def _told(least: float, schema: pa.Schema):
    def run(scene: pa.Table) -> pa.Table:
        boxes, ids, rows, known, truths, missing = _arrays(scene)
        seen = rows[known[rows]]
        took, value = scans.matched(boxes, ids, seen, truths, least, missing[seen])
        gid, best = np.full(len(ids), -1), np.zeros(len(ids))
        gid[seen], best[seen] = took, value
        gid, best, out = gid[rows], best[rows], scene.take(rows)
        status = np.where(gid >= 0, "true_positive", "false_positive")
        named = pa.array(ids[gid], mask=gid < 0)
        return pa.table([out["id"], out["tile"], out["conf"], status, named, best], names=["id", "tile", "conf", "status", "gid", "best_iou"]).cast(schema)

    return run


def outcomes(detections: DataFrame, truths: DataFrame, *, least: float = 0.5, cell: float = 64.0) -> DataFrame:
    """Each detection's fate: id, tile, conf, status, gid, best_iou.

    A match has its truth and overlap. A false positive has the largest overlap with the truths that no detection
    before it took, 0.0 if there is none. A task scans a tile of up to SCENE_ROWS boxes, and no table of pairs is made;
    larger tiles go through joins and rounds.
    """
    both, large = _scenes(detections, truths)
    schema = detections.select("id", "tile", F.col("conf").cast("double").alias("conf"), F.lit("").alias("status")).crossJoin(truths.select(F.col("id").alias("gid"))).withColumn("best_iou", F.lit(0.0)).schema
    small = both.where(~F.col("tile").isin(large) | F.col("tile").isNull()) if large else both
    told = small.groupBy("tile").applyInArrow(_told(least, to_arrow_schema(schema)), schema)
    if large:
        told = told.unionAll(_by_joins(detections.where(F.col("tile").isin(large)), truths, least, cell))
    return told


def _by_joins(detections: DataFrame, truths: DataFrame, least: float, cell: float) -> DataFrame:
    """Outcomes by joins and rounds. Only overlaps of at least least are written; the others are met again in a second join."""
    taken = written(greedy(edges(detections, truths, cell=cell), least), "matched")
    by = taken.select("gid", F.col("conf").alias("_conf"), F.col("pid").alias("_pid"))
    earlier = (F.col("_conf") > F.col("conf")) | ((F.col("_conf") == F.col("conf")) & (F.col("_pid") < F.col("pid")))
    rest = detections.join(taken.select(F.col("pid").alias("id")), "id", "left_anti")
    open_ = edges(rest, truths, cell=cell).join(by, "gid", "left").where(F.col("_pid").isNull() | ~F.coalesce(earlier, F.lit(False)))
    best = open_.groupBy(F.col("pid").alias("id")).agg(F.max("iou").alias("_open"))
    told = detections.select("id", "tile", F.col("conf").cast("double").alias("conf")).join(taken.select(F.col("pid").alias("id"), "gid", "iou"), "id", "left").join(best, "id", "left")
    status = F.when(F.col("gid").isNotNull(), "true_positive").otherwise("false_positive")
    return told.select("id", "tile", "conf", status.alias("status"), "gid", F.coalesce("iou", "_open", F.lit(0.0)).alias("best_iou"))


def precision_recall(told: DataFrame, truths: DataFrame) -> DataFrame:
    """One row: counts, precision and recall, 0.0 where nothing was predicted or is true."""
    n = told.agg(F.count("*").alias("predictions"), F.count_if(F.col("status") == "true_positive").alias("true_positives"))
    t = truths.agg(F.count("*").alias("truths"))
    tp = F.col("true_positives")
    return n.crossJoin(F.broadcast(t)).select(
        "predictions",
        "truths",
        "true_positives",
        (F.col("predictions") - tp).alias("false_positives"),
        (F.col("truths") - tp).alias("false_negatives"),
        B.ratio(tp.cast("double"), F.col("predictions").cast("double")).alias("precision"),
        B.ratio(tp.cast("double"), F.col("truths").cast("double")).alias("recall"),
    )


def _areas(told: DataFrame, hits: list[Column]) -> list[tuple[int, float]]:
    """For each of the columns hits of told (id, conf): its true values, and the sum of the precision envelope at them.

    Rows are dealt to ranges of confidence once for all columns; a range's numbers continue those before it, and its
    envelope is the larger of its own and the ranges' after it, of which there is a row each.
    """
    h, p = ([f"{c}{i}" for i in range(len(hits))] for c in "hp")
    order = [F.col("conf").desc_nulls_last(), F.col("id")]
    whole = written(told.select("id", "conf", *(c.alias(n) for c, n in zip(hits, h, strict=True))), "precision")  # read twice, by the sampling of the ranges too
    dealt = written(whole.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "precision")
    drop_written(whole)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("rows"), *(F.count_if(c).alias(c) for c in h))
    offsets = sizes.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("rows", *h)))
    within = Window.partitionBy("part").orderBy(*order)
    run = dealt.join(F.broadcast(offsets), "part").withColumn("n", F.col("_rows") + F.row_number().over(within))
    run = run.select("part", "n", *(F.when(F.col(c), (F.col(f"_{c}") + F.sum(F.col(c).cast("long")).over(within)) / F.col("n")).alias(q) for c, q in zip(h, p, strict=True)))
    run = written(run.where(F.coalesce(*p).isNotNull()), "precision")
    drop_written(dealt)
    after = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    later = run.groupBy("part").agg(*(F.max(q).alias(q) for q in p)).select("part", *(F.max(q).over(after).alias(f"_{q}") for q in p))
    backwards = Window.partitionBy("part").orderBy(F.col("n").desc())  # in linear time
    own = run.join(F.broadcast(later), "part").select(*p, *(F.greatest(F.max(q).over(backwards), f"_{q}").alias(f"best_{q}") for q in p))
    row = own.agg(*(F.count(q).alias(f"n_{q}") for q in p), *(F.sum(F.when(F.col(q).isNotNull(), F.col(f"best_{q}"))).alias(f"sum_{q}") for q in p)).first()
    drop_written(run)
    return [(row[f"n_{q}"], row[f"sum_{q}"] or 0.0) for q in p]


def _precisions(areas: list[tuple], truths: DataFrame, names: str) -> DataFrame:
    t = truths.agg(F.count("*").alias("truths"))
    all_ = truths.sparkSession.createDataFrame(areas, f"{names}true_positives long, total double").crossJoin(F.broadcast(t))
    area = F.round(B.ratio(F.col("total"), F.col("truths").cast("double")), 6)
    return all_.withColumn("average_precision", area).drop("total")


def average_precision(told: DataFrame, truths: DataFrame) -> DataFrame:
    """Area under the precision envelope over recall, and the counts it comes from."""
    return _precisions(_areas(told, [F.col("status") == "true_positive"]), truths, "")


#: The overlaps over which the mean average precision is taken.
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def _hits(thresholds: tuple[float, ...]):
    def run(scene: pa.Table) -> pa.Table:
        boxes, ids, rows, known, truths, _ = _arrays(scene)
        seen = rows[known[rows]]
        found = np.zeros((len(thresholds), len(ids)), bool)
        found[:, seen] = scans.matched_at(boxes, ids, seen, truths, thresholds)
        out = scene.take(rows)
        return pa.table([out["id"], out["conf"], *(pa.array(f[rows]) for f in found)], names=["id", "conf", *(f"t{i}" for i in range(len(thresholds)))])

    return run


def mean_average_precision(detections: DataFrame, truths: DataFrame, *, thresholds: tuple[float, ...] = THRESHOLDS, cell: float = 64.0) -> DataFrame:
    """Average precision at each least overlap, and the mean of all at each row: iou_threshold, true_positives, truths, average_precision, mean_ap.

    A task scans a tile of up to SCENE_ROWS boxes at all thresholds side by side; for larger tiles the overlaps of at least the
    smallest are found once, and the thresholds' matchings share their rounds.
    """
    names = [f"t{i}" for i in range(len(thresholds))]
    both, large = _scenes(detections, truths)
    small = both.where(~F.col("tile").isin(large) | F.col("tile").isNull()) if large else both
    told = small.groupBy("tile").applyInArrow(_hits(thresholds), detections.select("id", F.col("conf").cast("double").alias("conf"), *(F.lit(True).alias(n) for n in names)).schema)
    if large:
        rows = detections.where(F.col("tile").isin(large))
        every = F.array(*(F.lit(t) for t in thresholds))
        pairs = edges(rows, truths, cell=cell).withColumn("t", F.explode(F.filter(every, lambda t: F.col("iou") >= t)))
        taken = greedy(pairs, min(thresholds), "t").groupBy(F.col("pid").alias("id")).agg(*(F.bool_or(F.col("t") == t).alias(n) for t, n in zip(thresholds, names, strict=True)))
        told = told.unionAll(rows.select("id", "conf").join(taken, "id", "left").select("id", F.col("conf").cast("double"), *(F.coalesce(n, F.lit(False)).alias(n) for n in names)))
    found = _areas(told, [F.col(n) for n in names])
    rows = _precisions([(float(t), *a) for t, a in zip(thresholds, found, strict=True)], truths, "iou_threshold double, ")
    return rows.withColumn("mean_ap", F.round(F.avg("average_precision").over(Window.partitionBy()), 6))
