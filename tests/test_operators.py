"""Core operators on hand-made rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.functions import boxes as B
from quadrille.operators import audit, grouping, matching, raster, scans, selection, spatial, suppress, tiles

BOX = "id long, tile long, x0 double, y0 double, x1 double, y1 double, conf double"


def boxes(spark, rows):
    return spark.createDataFrame(rows, BOX)


def overlap(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    return max(0, w) * max(0, h)


def iou(a, b):
    area = lambda r: max(0, r[4] - r[2]) * max(0, r[5] - r[3])
    union = area(a) + area(b) - overlap(a, b)
    return overlap(a, b) / union if union else 0.0


def scene(n, seed, tiles_=3, side=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, s = rng.randrange(side), rng.randrange(side), rng.randrange(5, 40)
        out.append((i, rng.randrange(tiles_), float(x), float(y), float(x + s), float(y + s), rng.choice([None, 0.1, 0.5, 0.5, 0.9, rng.random()])))
    return out


def order(r):
    return (r[6] is None, -(r[6] or 0), r[0])


def test_box_measures(spark):
    rows = [(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0), (0.0, 0.0, 10.0, 10.0, 10.0, 0.0, 20.0, 10.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (5.0, 5.0, 0.0, 0.0, 0.0, 0.0, 9.0, 9.0)]
    f = spark.createDataFrame(rows, "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    a, b = B.box("a"), B.box("b")
    got = f.select(B.iou(a, b), B.overlaps(a, b), B.overlaps(a, b, closed=True), B.area(a), B.visible(b, a)).collect()
    assert [r[0] for r in got] == [25 / 175, 0.0, 0.0, 0.0]
    assert [r[1] for r in got][:2] == [True, False] and [r[2] for r in got][:2] == [True, True]
    assert [r[3] for r in got] == [100.0, 100.0, 0.0, 0.0] and got[0][4] == 0.25


@pytest.mark.parametrize("cell", [7.0, 64.0])
def test_overlap_pairs_equal_nested_loop(spark, cell):
    rows = scene(80, 1) + [(900, 0, None, 0.0, 5.0, 5.0, 0.5)]
    got = {(r.l_id, r.r_id) for r in spatial.self_pairs(boxes(spark, rows), cell=cell).collect()}
    known = [r for r in rows if r[2] is not None]
    assert got == {(a[0], b[0]) for a in known for b in known if a[0] < b[0] and overlap(a, b) > 0}
    assert spatial.self_pairs(boxes(spark, rows).limit(0), cell=cell).count() == 0


@pytest.mark.parametrize("part", [1, 4])
def test_crowded_cells_lose_and_repeat_no_pair(spark, monkeypatch, part):
    monkeypatch.setattr(spatial, "PART_ROWS", part)
    left, right = scene(60, 41), scene(9, 42)
    left += [(500 + i, 0, 3.0, 3.0, 9.0, 9.0, 0.5) for i in range(20)]
    got = sorted((r.l_id, r.r_id) for r in spatial.overlap_pairs(boxes(spark, left), boxes(spark, right), cell=64.0).collect())
    assert got == sorted((a[0], b[0]) for a in left for b in right if overlap(a, b) > 0)
    points = spark.createDataFrame([(i, float(i % 7), 4.0) for i in range(30)], "p long, px double, py double")
    held = sorted((r.p, r.id) for r in spatial.points_in_boxes(points, boxes(spark, left), cell=64.0).select("p", "id").collect())
    assert held == sorted((i, b[0]) for i in range(30) for b in left if b[2] <= i % 7 <= b[4] and b[3] <= 4.0 <= b[5])


def test_touching_boxes_meet_only_when_closed(spark):
    a = boxes(spark, [(1, 0, 0.0, 0.0, 10.0, 10.0, 1.0)])
    b = boxes(spark, [(2, 0, 10.0, 0.0, 20.0, 10.0, 1.0)])
    assert spatial.overlap_pairs(a, b, cell=8.0).count() == 0
    assert spatial.overlap_pairs(a, b, cell=8.0, closed=True).count() == 1
    assert spatial.without_overlap(a, b, "id", cell=8.0).count() == 0


@pytest.mark.parametrize(("seed", "tail"), [(2, 0), (3, 9), (2, 2_000_000), (3, 2_000_000)])
def test_greedy_matching_equals_sequential_scan(spark, monkeypatch, seed, tail):
    """By rounds to the end, by some rounds, and by one scan."""
    monkeypatch.setattr(matching, "TAIL_ROWS", tail)
    preds, truths = scene(60, seed), scene(50, seed + 10)
    free, want = {t[0]: t for t in truths}, {}
    for p in sorted(preds, key=order):
        near = [(-(iou(p, t)), t[0]) for t in free.values() if t[1] == p[1] and iou(p, t) > 0]
        best = min(near, default=None)
        if best and -best[0] >= 0.5:
            want[p[0]] = ("true_positive", best[1], -best[0])
            del free[best[1]]
        else:
            want[p[0]] = ("false_positive", None, -best[0] if best else 0.0)
    told = matching.outcomes(boxes(spark, preds), boxes(spark, truths), cell=16.0).collect()
    matched = {r.id: (r.status, r.gid) for r in told}
    assert matched == {k: v[:2] for k, v in want.items()}
    known = {r.id: r.best_iou for r in told if r.conf is not None}
    assert all(math.isclose(known[i], want[i][2]) for i in known)


def test_matching_without_rows(spark):
    empty, some = boxes(spark, []), boxes(spark, scene(4, 1))
    assert matching.outcomes(empty, some).count() == 0
    row = matching.precision_recall(matching.outcomes(some, empty), empty).first()
    assert (row.precision, row.recall, row.false_positives) == (0.0, 0.0, 4)


@pytest.mark.parametrize(("seed", "tail"), [(5, 0), (6, 9), (5, 2_000_000), (6, 2_000_000)])
def test_suppression_and_lineage_equal_sequential_scan(spark, monkeypatch, seed, tail):
    """By rounds to the end, by some rounds, and by one scan."""
    monkeypatch.setattr(suppress, "TAIL_ROWS", tail)
    rows = scene(70, seed)
    kept, by = [], {}
    for r in sorted(rows, key=order):
        above = [k for k in kept if k[1] != r[1] and iou(k, r) >= 0.2]
        if above:
            by[r[0]] = above[0][0]
        else:
            kept.append(r)
    frame = boxes(spark, rows)
    assert {r.id for r in suppress.nms(frame, least=0.2, cell=16.0).collect()} == {k[0] for k in kept}
    links = suppress.lineage(frame, least=0.2, cell=16.0)
    assert {r.id: r.kept_id for r in links.collect()} == by
    counts = {r.id: r.source_detection_count for r in suppress.candidates(frame, links).collect()}
    assert counts == {k[0]: 1 + sum(v == k[0] for v in by.values()) for k in kept}


def test_a_long_chain_is_one_scan():
    """Of boxes each of which conflicts with the next, every other one falls."""
    top = np.arange(100_000)
    assert sorted(suppress.fallen(top, top + 1).tolist()) == list(range(1, 100_001, 2))
    assert suppress.fallen(top[:0], top[:0]).tolist() == []


def test_same_tile_never_suppresses(spark):
    frame = boxes(spark, [(1, 0, 0.0, 0.0, 9.0, 9.0, 0.9), (2, 0, 0.0, 0.0, 9.0, 9.0, 0.8), (3, 1, 0.0, 0.0, 9.0, 9.0, 0.8)])
    assert {r.id for r in suppress.nms(frame, least=0.5).collect()} == {1, 2}


def test_diverse_with_seeds(spark):
    rows = [(i, 0, float(x), 0.0, float(x + 10), 10.0, 1 - i / 100) for i, x in enumerate((0, 2, 9, 20, 22, 40))]
    frame = boxes(spark, rows)
    got = [r.id for r in suppress.diverse(frame, 3, most=0.25, tile_area=100.0).orderBy("rank").collect()]
    assert got == [0, 2, 3]
    seeds = frame.where("id = 3")
    assert [r.id for r in suppress.diverse(frame, 3, most=0.25, tile_area=100.0, seeds=seeds).orderBy("rank").collect()] == [0, 2]


@pytest.mark.parametrize(("k", "step", "seeds"), [(12, 5, 0), (500, 7, 2), (3, 4_096, 3), (9, 40, 1)])
def test_diverse_equals_sequential_scan(spark, monkeypatch, k, step, seeds):
    """The running maximum of the overlap with what was chosen before, and steps that end before k rows are found."""
    monkeypatch.setattr(suppress, "STEP_ROWS", step)
    rows = [*scene(90, 21), (900, 0, None, 0.0, 5.0, 5.0, 0.95)]
    known = rows[:seeds]
    taken, want = list(known), []
    share = lambda r: max((0.0 if None in (a[2], r[2]) else overlap(a, r) / 400 for a in taken), default=0.0)
    for r in sorted(rows[seeds:], key=order):
        if share(r) <= 0.25 and len(taken) < k:
            want.append((len(want) + 1, r[0], share(r)))
            taken.append(r)
    got = suppress.diverse(boxes(spark, rows), k, most=0.25, tile_area=400.0, seeds=boxes(spark, known) if known else None)
    assert [(r["rank"], r.id, r.max_overlap) for r in got.orderBy("rank").collect()] == want
    assert suppress.diverse(boxes(spark, []), k, most=0.25, tile_area=400.0).count() == 0


def test_sweep_equals_one_suppression_a_threshold(spark):
    frame = boxes(spark, scene(80, 31))
    got = {r.iou_threshold: (r.raw, r.kept, r.suppressed) for r in suppress.sweep(frame, [0.1, 0.3, 0.95], cell=16.0).collect()}
    kept = {t: suppress.nms(frame, least=t, cell=16.0).count() for t in (0.1, 0.3, 0.95)}
    assert got == {t: (80, n, 80 - n) for t, n in kept.items()}


def plain_ap(hits, truths):
    tp, precision = 0, []
    for n, hit in enumerate(hits, 1):
        tp += hit
        precision.append(tp / n)
    return round(sum(max(precision[i:]) for i, hit in enumerate(hits) if hit) / truths, 6)


def test_average_precision_over_ranges(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, 0.2, 0.5, 0.9, rng.random()]), rng.random() < 0.4) for i in range(300)]
    told = spark.createDataFrame([(i, c, "true_positive" if h else "false_positive") for i, c, h in rows], "id long, conf double, status string").repartition(5)
    hits = [h for _, c, h in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    truths = spark.range(400)
    row = matching.average_precision(told, truths).first()
    assert (row.true_positives, row.truths, row.average_precision) == (sum(hits), 400, plain_ap(hits, 400))
    none = matching.average_precision(told.limit(0), truths).first()
    assert (none.true_positives, none.average_precision) == (0, 0.0)


def test_mean_average_precision_equals_one_matching_a_threshold(spark):
    preds, truths = boxes(spark, scene(60, 2)), boxes(spark, scene(50, 12))
    got = {r.iou_threshold: (r.true_positives, r.average_precision) for r in matching.mean_average_precision(preds, truths, thresholds=(0.2, 0.5, 0.99), cell=16.0).collect()}
    for t, found in got.items():
        row = matching.average_precision(matching.outcomes(preds, truths, least=t, cell=16.0), truths).first()
        assert found == (row.true_positives, row.average_precision)
    assert len(got) == 3 and got[0.2][0] > got[0.99][0]


def test_within_leaves_out_contact_of_the_edge(spark):
    rows = [(1.0, 1.0, 2.0, 2.0), (0.0, 0.0, 9.0, 9.0), (0.0, 3.0, 0.0, 4.0), (0.0, 3.0, 0.0, 3.0), (3.0, 3.0, 3.0, 3.0), (8.0, 8.0, 10.0, 9.0)]
    f = spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double")
    outer = tuple(F.lit(v) for v in (0.0, 0.0, 9.0, 9.0))
    got = f.select(B.within(B.box(), outer), B.covers(outer, B.box())).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, True), (False, True), (False, True), (True, True), (False, False)]


def test_unit_boxes_and_clipped_labels(spark):
    f = spark.createDataFrame([(0.5, 0.5, 0.2, 0.4), (0.0, 0.5, 0.5, 0.5), (1.5, 0.5, 0.5, 0.5)], "x double, y double, w double, h double")
    c = [F.col(n) for n in "xywh"]
    got = f.select(F.array(*B.unit_to_pixel(*c, 100.0, 50.0)).alias("p"), B.clip_label(*c).alias("l")).collect()
    assert [round(v, 9) for v in got[0].p] == [40.0, 15.0, 60.0, 35.0]
    assert [r.l and tuple(round(v, 9) for v in r.l) for r in got] == [(0.5, 0.5, 0.2, 0.4), (0.125, 0.5, 0.25, 0.5), None]


def test_decoding_fails_on_an_unknown_value(spark):
    f = spark.createDataFrame([("True",), ("false",), (None,)], "v string")
    known = {"True": True, "true": True, "False": False, "false": False}
    assert [r[0] for r in f.select(audit.decoded(F.col("v"), known)).collect()] == [True, False, None]
    with pytest.raises(Exception, match="unknown value: 1.0"):
        spark.createDataFrame([("1.0",)], "v string").select(audit.decoded(F.col("v"), known)).collect()


def test_windows_that_touch_nothing(spark):
    tried = tiles.mined(spark, 300, 42, width=60, height=40, size=8)
    places = tried.collect()
    assert tried.columns[2] == "attempt" and len({(r.row_start, r.col_start) for r in places}) == len(places) <= 300
    assert all(0 <= r.row_start <= 32 and 0 <= r.col_start <= 52 for r in places)
    objects = spark.createDataFrame([(1, 100.0, 100.0, 200.0, 200.0), (2, 300.0, 0.0, 310.0, 400.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    used = spark.createDataFrame([(places[0].row_start, places[0].col_start)], "row_start long, col_start long")
    want = []
    for r in sorted(places, key=lambda r: r.attempt):
        x0, x1, y0, y1 = r.col_start * 10.0, (r.col_start + 8) * 10.0, 400.0 - (r.row_start + 8) * 10.0, 400.0 - r.row_start * 10.0
        meets = any(a <= x1 and x0 <= c and b <= y1 and y0 <= d for a, b, c, d in ((100, 100, 200, 200), (300, 0, 310, 400)))
        if x1 <= 500 and not meets and r != places[0]:
            want.append(r.attempt)
    got = tiles.clean_windows(tried, objects, 20, region=(0.0, 500.0), size=8, left=0.0, top=400.0, resolution=10.0, cell=80.0, used=used)
    assert [r.attempt for r in got.orderBy("attempt").collect()] == want[:20] and len(want) > 0


def test_contamination_of_tiles_without_labels(spark):
    """Tile a shows a fifth of object 1, tile b half of object 2 (a label), tile c nothing, tile d an object of another split and one on a boundary."""
    t = [("a", "train", 0.0), ("b", "train", 100.0), ("c", "train", 200.0), ("d", "test", 300.0)]
    frame = spark.createDataFrame([(n, s, x, 0.0, x + 50, 50.0) for n, s, x in t], "tile_name string, split string, x0 double, y0 double, x1 double, y1 double")
    o = [(1, "train", 42.0, 82.0), (2, "train", 130.0, 170.0), (3, "train", 310.0, 320.0), (4, "exclude_boundary", 340.0, 380.0)]
    objects = spark.createDataFrame([(i, x, 0.0, y, 10.0, s) for i, s, x, y in o], "id long, x0 double, y0 double, x1 double, y1 double, split string")
    got = {r.tile_name: r for r in audit.contamination(frame, tiles.seen(frame, objects, cell=40.0, same_split=False)).collect()}
    assert set(got) == {"a", "c", "d"}
    assert (got["a"].same_split_partial, got["a"].max_visible, got["a"].partial_ids) == (1, 0.2, "1")
    assert (got["c"].max_visible, got["c"].partial_ids) == (0.0, "") and (got["d"].other_split, got["d"].excluded_boundary) == (1, 1)


def test_a_window_s_ranges_reach_the_scan(spark, tmp_path):
    px = spark.range(20 * 30).selectExpr("'r' AS raster_id", "'x' AS band", "id div 30 AS row", "id % 30 AS col", "cast(id AS double) AS value")
    raster.write_raster(px, str(tmp_path / "raster"), {"x": "near infrared"})
    back = raster.window(spark.read.parquet(str(tmp_path / "raster")), 3, 4, 5, 6)
    assert sorted(r.value for r in back.collect()) == [r * 30.0 + c for r in range(3, 8) for c in range(4, 10)]
    assert {r.description for r in back.collect()} == {"near infrared"}
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = back.select("*")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(f in plan for f in ("GreaterThanOrEqual(row,3)", "LessThanOrEqual(row,7)", "GreaterThanOrEqual(col,4)", "LessThanOrEqual(col,9)"))
    row = raster.metadata(px, 10.0, 0.0, 200.0, "EPSG:32638").first()
    assert (row.height, row.width, row.dtype, row.resolution, row.crs) == (20, 30, "double", 10.0, "EPSG:32638") and raster.pixel_of(45.0, 165.0, 0.0, 200.0, 10.0) == (3, 4)


# The published raster's left and right edge, pixel, rows, and the two boundaries between its splits.
LEFT, RIGHT, PIXEL, ROWS, WEST, EAST = 499_960.0, 609_780.0, 10.0, 10_980, 562_178.8103648677, 573_493.2756031455


@pytest.mark.parametrize(
    ("size", "step", "want"),
    [(512, 384, {"train": 464, "val": 87, "test": 290}), (320, 240, {"train": 1196, "val": 230, "test": 690})],
)
def test_published_tile_counts(spark, size, step, want):
    regions = spark.createDataFrame([("train", LEFT, WEST), ("val", WEST, EAST), ("test", EAST, RIGHT)], "split string, x0 double, x1 double")
    g = tiles.grid(regions, height=ROWS, width=10_982, size=size, step=step, left=LEFT, top=3_600_010.0, resolution=PIXEL)
    assert {r.split: r["count"] for r in g.groupBy("split").count().collect()} == want


def test_published_pixel_counts(spark):
    """A pixel is of the split in which the middle of its column lies."""
    columns = spark.range(10_982).select("id", B.pixel_centre(F.col("id"), LEFT, PIXEL).alias("x"))
    train, test = columns.where(F.col("x") < WEST), columns.where(F.col("x") >= EAST)
    assert (train.count() * ROWS, test.count() * ROWS) == (68_317_560, 39_846_420)
    assert train.agg(F.max("id")).first()[0] == 6_221 and test.agg(F.min("id")).first()[0] == 7_353


def test_external_grid_has_42_by_42_tiles(spark):
    regions = spark.createDataFrame([("all", 0.0, 100_000.0)], "split string, x0 double, x1 double")
    g = tiles.grid(regions, height=10_000, width=10_000, size=320, step=240, left=0.0, top=100_000.0, resolution=10.0)
    assert g.count() == 1764
    assert tiles.grid(regions, height=10_000, width=10_000, size=512, step=384, left=0.0, top=100_000.0, resolution=10.0).count() == 676
    assert tiles.grid(regions, height=100, width=10_000, size=320, step=240, left=0.0, top=100_000.0, resolution=10.0).count() == 0


def test_classes_at_their_bounds(spark):
    f = spark.createDataFrame([(16718.0,), (16718.5,), (129300.0,), (129299.0,), (None,)], "a double")
    assert [r[0] for r in f.select(grouping.size_class(F.col("a"), 16718.0, 129300.0)).collect()] == ["small", "medium", "large", "medium", None]
    t = spark.createDataFrame([(1 / 3,), (2 / 3,), (0.34,), (0.9,)], "r double")
    third = grouping.by_bounds(F.col("r"), [F.lit(1.0) / 3, F.lit(2.0) / 3], ["west", "middle", "east"], right_closed=True)
    assert [r[0] for r in t.select(third).collect()] == ["west", "middle", "middle", "east"]
    left = grouping.by_bounds(F.col("r"), [F.lit(0.34), F.lit(0.9)], ["a", "b", "c"], right_closed=False)
    assert [r[0] for r in t.select(left).collect()] == ["a", "b", "b", "c"]


# Published groups, objects and those found, in order, and the recall of each and of all.
PUBLISHED_RECALL = {
    "size": [("small", 49, 0, 0.0), ("medium", 101, 37, 0.36633663366336633), ("large", 51, 33, 0.6470588235294118)],
    "third": [("western third", 114, 36, 0.3157894736842105), ("middle third", 45, 13, 0.28888888888888886), ("eastern third", 42, 21, 0.5)],
}


@pytest.mark.parametrize("groups", PUBLISHED_RECALL.values(), ids=PUBLISHED_RECALL)
def test_published_recall_of_groups_and_all(spark, groups):
    rows = [(name, i < found) for name, n, found, _ in groups for i in range(n)]
    f = spark.createDataFrame(rows, "name string, detected boolean")
    aggregates = [F.count("*").alias("n"), F.count_if("detected").alias("d"), F.avg(F.col("detected").cast("double")).alias("recall")]
    got = {r.name: (r.n, r.d, r.recall) for r in grouping.with_total(f, "name", aggregates, "overall").collect()}
    assert got == {name: (n, found, recall) for name, n, found, recall in groups} | {"overall": (201, 70, 0.3482587064676617)}


# The published selection of 30 windows of 512 pixels, by rank: first row, first column, and the largest
# share that a window has in common with one before it, where there is any.
SELECTED = [
    (3357, 749), (3231, 5265), (7315, 5266), (3894, 5090), (470, 5279), (10276, 5518), (9868, 130), (6554, 2385),
    (4494, 1501), (3339, 1447), (9988, 1102), (8078, 3766), (8139, 633), (6449, 2933), (2728, 1188), (100, 5156),
    (4399, 3220), (4, 5538), (8743, 1678), (10467, 715), (3616, 3587), (5227, 1976), (9787, 5295), (6102, 5223),
    (5240, 1499), (10434, 3698), (10443, 1402), (7333, 3712), (7759, 408), (9600, 827),
]
SHARES = {16: 0.21071624755859375, 18: 0.206298828125, 20: 0.015735626220703125, 23: 0.025356292724609375, 25: 0.06662368774414062, 27: 0.0460968017578125, 29: 0.1445159912109375, 30: 0.1121063232421875}


def test_published_selection_and_its_largest_overlaps(spark):
    rows = [(i, 0, float(c), float(r), c + 512.0, r + 512.0, 1 - i / 100) for i, (r, c) in enumerate(SELECTED, 1)]
    got = suppress.diverse(boxes(spark, rows), 30, most=0.25, tile_area=512.0 * 512.0).orderBy("rank").collect()
    assert [(r["rank"], r.id, r.max_overlap) for r in got] == [(i, i, SHARES.get(i, 0.0)) for i in range(1, 31)]


def test_dense_groups_and_quantiles(spark):
    f = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 8.0)], "k string, v double")
    got = grouping.dense(f, {"k": ["a", "b", "c"]}, [F.count("*").alias("n")], ["n"])
    assert {r.k: r.n for r in got.collect()} == {"a": 2, "b": 2, "c": 0}
    table = grouping.quantile_table(f, "v", {"Q1": 0.25, "Q2": 0.5}, "all").collect()
    assert {r["quantile"]: r["value"] for r in table} == {"Q1": 1.75, "Q2": 3.0}


def test_bytes_round_half_to_even_and_mark_missing(spark):
    f = spark.createDataFrame([("x", 0, 0, float("nan")), ("x", 0, 1, -9999.0), ("x", 0, 2, 5.0), ("x", 0, 3, 1e9)], "band string, row int, col int, value double")
    px = raster.valid(f, -9999.0)
    stats = spark.createDataFrame([("x", 5.0, 1.0)], "band string, mean double, deviation double")
    got = {r.col: r.byte for r in raster.standardised(px, stats).collect()}
    assert got == {0: 128, 1: 128, 2: 128, 3: 255}
    flat = raster.standardised(px, spark.createDataFrame([("x", 5.0, 0.0)], "band string, mean double, deviation double"))
    assert {r.col: r.byte for r in flat.collect()}[2] == 128


def test_constant_blocks(spark):
    rows = [(r, c, 1.0 if r < 3 else float(c)) for r in range(6) for c in range(6)]
    got = raster.constant_blocks(spark.createDataFrame(rows, "row long, col long, value double"))
    first = {(r.row_offset, r.col_offset): (r.constant_blocks, r.total_blocks) for r in got.collect()}
    assert first[0, 0] == (2, 4) and first[1, 1] == (0, 1)


def test_lint_names_the_first_fault(spark):
    lines = ["0 0.5 0.5 0.1 0.1", "0 0.5 0.5 0.1", "1 0.5 0.5 0.1 0.1", "0 x 0.5 0.1 0.1", "0 inf 0.5 0.1 0.1", "0 1.5 0.5 0.1 0.1", "0 0.5 0.5 0 0.1", "0 0.99 0.5 0.1 0.1", ""]
    got = audit.lint(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [r.fault for r in got] == [None, "tokens", "class", "number", "number", "centre", "size", "corner", "tokens"]


def test_lookup_fails_on_a_repeated_key(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeats a key"):
        audit.lookup(left, right, ["k"]).collect()
    assert {(r.k, r.v) for r in audit.lookup(left, right.limit(1), ["k"]).collect()} >= {(2, None)}
    with pytest.raises(ValueError, match="missing columns: z"):
        audit.required(left, ["k", "z"])


def test_review_states_lock_28_of_30(spark):
    """A selection of 30: some excluded, refilled as pending, excluded again, then locked with new ranks."""
    pool = spark.createDataFrame([(i, 1 - i / 1000) for i in range(100)], "id long, conf double")
    order_ = [F.col("conf").desc(), F.col("id")]
    first = pool.orderBy(*order_).limit(30).withColumn("decision", F.lit("keep"))
    once = selection.refilled(selection.decided(first, [1, 2, 3, 4, 5, 6]), pool, 30, order_)
    assert {r.decision: r["count"] for r in once.groupBy("decision").count().collect()} == {"keep": 24, "replacement_pending_qc": 6}
    final = selection.locked(selection.decided(once, [30, 31]), order_)
    ranks = [r.final_rank for r in final.orderBy("final_rank").collect()]
    assert ranks == list(range(1, 29)) and final.where("decision <> 'keep'").count() == 0


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    n = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = selection.upserted(t, n, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, selection.upserted(once, n, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_upsert_of_a_repeated_key(spark):
    t, n = spark.createDataFrame([(1, 5)], "k int, v int"), spark.createDataFrame([(1, 7), (1, 9), (2, 3)], "k int, v int")
    with pytest.raises(Exception, match="a key repeats"):
        selection.upserted(t, n, ["k"]).collect()
    assert sorted(map(tuple, selection.upserted(t, n, ["k"], [F.col("v")]).collect())) == [(1, 9), (2, 3)]
    lists = [spark.createDataFrame([(k,)], "k int") for k in (1, 2)]
    assert [tuple(r) for r in selection.excluded(n.unionAll(t), "k", *lists).collect()] == []


def test_pages_and_selections_a_group(spark):
    f = spark.range(20).selectExpr("id", "id % 2 AS g")
    got = {(r.g, r.id): (r.page, r.place) for r in selection.paged(selection.top(f, 7, [F.col("id")], ["g"]), 3, [F.col("id")], ["g"]).collect()}
    assert got == {(g, 2 * i + g): (i // 3, i % 3) for g in (0, 1) for i in range(7)}
    first = selection.top(f, 3, [F.col("id")], ["g"]).withColumn("decision", F.when(F.col("id").isin(0, 2, 4), "exclude").otherwise("keep"))
    filled = selection.refilled(first, f, 3, [F.col("id")], by=["g"])
    ranks = {(r.g, r.id): r.final_rank for r in selection.locked(filled, [F.col("id")], by=["g"]).collect()}
    assert ranks == {(0, 6): 1, (0, 8): 2, (0, 10): 3, (1, 1): 1, (1, 3): 2, (1, 5): 3}


@pytest.mark.parametrize("few", [8_000, 200_000])
def test_quantiles_a_group(spark, monkeypatch, few):
    """Sorted at once, and between brackets."""
    monkeypatch.setattr(grouping, "FEW", few)
    f = spark.range(30_000).selectExpr("id % 3 AS g", "cast(id * id % 10007 AS double) AS v")
    values = {g: sorted(float(i * i % 10_007) for i in range(g, 30_000, 3)) for g in range(3)}
    got = {r.g: r.q for r in grouping.quantiles(f, F.col("v"), [0.5, 0.1], by="g").collect()}
    assert {g: [round(x, 9) for x in q] for g, q in got.items()} == {g: [round((v[4_999] + v[5_000]) / 2, 9), round(v[999] + 0.9 * (v[1_000] - v[999]), 9)] for g, v in values.items()}


@pytest.mark.parametrize("few", [8_000, 200_000])
def test_quantiles_equal_sorted_values(spark, monkeypatch, few):
    monkeypatch.setattr(grouping, "FEW", few)
    rng = random.Random(4)
    for values in ([], [3.0], [1.0, 2.0], [rng.choice([1.0, 2.0, 2.5]) for _ in range(101)], [rng.gauss(0, 1) for _ in range(4_001)], [rng.gauss(0, 1) for _ in range(20_002)]):
        f = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        at, ordered = [0.0, 0.25, 0.5, 0.7, 0.999, 1.0], sorted(values)
        want = []
        for p in at:
            place = p * (len(ordered) - 1)
            i = math.floor(place)
            want.append(None if not ordered else ordered[i] + (ordered[min(i + 1, len(ordered) - 1)] - ordered[i]) * (place - i))
        assert grouping.quantiles(f, F.col("v"), at).first().q == pytest.approx(want, rel=1e-12) if ordered else want


def test_numbers_over_partitions(spark):
    f = spark.range(1_000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50))).repartition(7)
    got = [(r.n, r.k, r.id) for r in grouping.numbered(f, "n", F.col("k").desc(), F.col("id")).orderBy("n").collect()]
    assert [n for n, _, _ in got] == list(range(1, 1_001)) and [(-k, i) for _, k, i in got] == sorted((-k, i) for _, k, i in got)
    assert grouping.numbered(f.limit(0), "n", F.col("id")).count() == 0


def test_boxes_that_hold_points_are_found_without_pairs(spark, monkeypatch):
    """Points that repeat, lie on edges or are null, in cells that are crowded or not."""
    left = scene(300, 8)
    points = spark.createDataFrame([(float(i % 40), float(3 * (i % 13))) for i in range(2_000)] + [(None, 1.0)], "px double, py double")
    want = sorted(b[0] for b in left if any(b[2] <= i % 40 <= b[4] and b[3] <= 3 * (i % 13) <= b[5] for i in range(520)))
    for part in (50_000, 20):
        monkeypatch.setattr(spatial, "PART_ROWS", part)
        found = spatial.boxes_with_points(points, boxes(spark, left), "id", cell=64.0)
        assert sorted(r.id for r in found.collect()) == want
        assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("limit", "tail"), [(2_000_000, 0), (0, 0), (0, 9), (40, 2_000_000)])
def test_matching_by_scans_and_by_joins(spark, monkeypatch, limit, tail):
    """Tiles that a task scans, tiles that are too large for it, and both, with null corners and tiles; no pair is written by a scan."""
    monkeypatch.setattr(matching, "SCENE_ROWS", limit)
    monkeypatch.setattr(matching, "TAIL_ROWS", tail)
    monkeypatch.setattr(matching.scans, "BATCH", 7)
    monkeypatch.setattr(matching.scans, "CHUNK", 50)
    labels, wrote = [], matching.written
    monkeypatch.setattr(matching, "written", lambda frame, label: (labels.append(label), wrote(frame, label))[1])
    preds = [*scene(90, 4), (900, 0, None, 0.0, 5.0, 5.0, 0.95), (901, None, 1.0, 1.0, 99.0, 99.0, 0.9), (902, 1, 3.0, 3.0, 9.0, 9.0, math.nan), (903, 0, 0.0, 0.0, 5_000.0, 5_000.0, 0.7)]
    preds += [(1_000 + r[0], 9, *r[2:]) for r in preds[:12]]
    truths = [*scene(80, 14), (904, None, 1.0, 1.0, 99.0, 99.0, None), (905, 0, 0.0, 0.0, 4_900.0, 5_000.0, None)]
    none = lambda r: None in r[1:6]
    key = lambda r: (r[6] is None, not (r[6] is not None and math.isnan(r[6])), 0 if r[6] is None or math.isnan(r[6]) else -r[6], r[0])
    free, want = {t[0]: t for t in truths if not none(t)}, {}
    for p in sorted(preds, key=key):
        among = truths if p[6] is None else free.values()
        near = min(((-iou(p, t), t[0]) for t in free.values() if not none(p) and t[1] == p[1] and iou(p, t) > 0), default=(0.0, None))
        if -near[0] >= 0.5:
            want[p[0]] = ("true_positive", near[1], -near[0])
            del free[near[1]]
        else:
            want[p[0]] = ("false_positive", None, max((iou(p, t) for t in among if not none(p) and not none(t) and t[1] == p[1]), default=0.0))
    told = matching.outcomes(boxes(spark, preds), boxes(spark, truths), cell=64.0).collect()
    assert {r.id: (r.status, r.gid, r.best_iou) for r in told} == want
    assert limit < 2_000_000 or labels == []
    assert len(told) == len(preds)
    row = matching.mean_average_precision(boxes(spark, preds), boxes(spark, truths), thresholds=(0.5, 0.8), cell=64.0).orderBy("iou_threshold").first()
    hits = [want[p[0]][0] == "true_positive" for p in sorted(preds, key=key)]
    assert (row.true_positives, row.average_precision) == (sum(hits), plain_ap(hits, len(truths)))


@pytest.mark.parametrize("square", [3, 256])
def test_overlaps_are_counted_without_pairs(spark, monkeypatch, square):
    """Copies, halves in the seventh digit, negative and null corners, and boxes over many blocks."""
    monkeypatch.setattr(spatial.scans, "SQUARE", square)
    rows = [(i, r[1], *(c - 60 for c in r[2:6]), 1.0) for i, r in enumerate(scene(90, 17) * 2)]
    rows += [(500, 0, 200.0, 200.0, 201.0, 201.0, 1.0), (501, 1, 200.0, 200.0, 232.0, 220.0, 1.0), (502, 2, None, 0.0, 5.0, 5.0, 1.0), (503, 1, -90.0, -90.0, 400.0, 400.0, 1.0)]
    pairs = spatial.self_pairs(boxes(spark, rows), cell=64.0, also=F.col("l_tile") != F.col("r_tile")).select(F.round(B.iou(B.box("l_"), B.box("r_")), 6).alias("iou")).where("iou > 0")
    want = {r.iou: r["count"] for r in pairs.groupBy("iou").count().collect()}
    assert {r.iou: r.n for r in spatial.overlap_counts(boxes(spark, rows), cell=16.0).collect()} == want
    assert 0.001563 in want  # 1 / 640


@pytest.mark.parametrize(("limit", "cells", "side"), [(2_000_000, 8, 300), (2_000_000, 0, 300), (2_000_000, 0, 900), (0, 8, 300)])
def test_suppression_in_blocks_equals_sequential_scan(spark, monkeypatch, limit, cells, side):
    """Many small blocks over several rounds, one block, and blocks that are too crowded; a block writes no conflicts."""
    monkeypatch.setattr(suppress, "BLOCK_ROWS", limit)
    monkeypatch.setattr(suppress, "BLOCK_CELLS", cells)
    monkeypatch.setattr(suppress, "MARGIN_CELLS", cells / 4)
    labels, wrote = [], suppress.written
    monkeypatch.setattr(suppress, "written", lambda frame, label: (labels.append(label), wrote(frame, label))[1])
    rows = [*((r[0], r[1], *(c - 40 for c in r[2:6]), r[6]) for r in scene(900, 41, side=side)), (950, 0, None, 0.0, 5.0, 5.0, 0.95), (951, None, 1.0, 1.0, 9.0, 9.0, 0.99), (952, 2, 3.0, 3.0, 9.0, 9.0, math.nan)]
    rows = [r for r in rows if not (r[2] is not None and 2 < r[2] < 10 and r[0] % 2)]
    key = lambda r: (r[6] is None, not (r[6] is not None and math.isnan(r[6])), 0 if r[6] is None or math.isnan(r[6]) else -r[6], r[0])
    kept, by = [], {}
    for r in sorted(rows, key=key):
        above = [k for k in kept if None not in (*k[1:6], *r[1:6]) and k[1] != r[1] and iou(k, r) >= 0.2]
        if above:
            by[r[0]] = (above[0][0], iou(above[0], r))
        else:
            kept.append(r)
    frame = boxes(spark, rows)
    assert {r.id for r in suppress.nms(frame, least=0.2, cell=16.0).collect()} == {k[0] for k in kept}
    assert limit == 0 or cells or labels.count("blocks") > 1
    assert {r.id: (r.kept_id, r.iou) for r in suppress.lineage(frame, least=0.2, cell=16.0).collect()} == by
    assert {r.iou_threshold: r.suppressed for r in suppress.sweep(frame, [0.2, 0.6], cell=16.0).collect()}[0.2] == len(by)
    assert limit == 0 or not {"conflicts"} & set(labels)


def test_copies_share_the_fate_of_their_first():
    """Of repeated boxes a scan takes the first of each; it is far smaller, and tells what a scan of all tells."""
    rng = np.random.default_rng(3)
    corner, side = rng.integers(0, 60, (2, 4_000)), rng.integers(8, 12, 4_000)
    boxes, tile = np.concatenate([corner, corner + side]).astype(float), rng.integers(0, 3, 4_000)
    boxes, tile = np.tile(boxes, 3)[:, (at := rng.permutation(12_000))], np.tile(tile, 3)[at]
    rows, of = scans.copies(boxes, tile)
    assert len(rows) <= 4_000 and (np.diff(rows) > 0).all() and (rows[of] <= np.arange(12_000)).all()
    assert (boxes[:, rows][:, of] == boxes).all() and (tile[rows][of] == tile).all()
    whole = boxes[0] < 50
    for least in (0.3, 0.7):
        every = scans.survived(boxes, tile, np.zeros(12_000, int), whole, least)
        assert (scans.survived(boxes[:, rows], tile[rows], np.zeros(len(rows), int), whole[rows], least)[of] == every).all()
        kept = np.nonzero(every == scans.KEPT)[0]
        fell = np.nonzero(every == scans.GONE)[0]
        first, value = scans.first_reaching(boxes, tile, kept, fell, least)
        own = {}
        for r in rng.choice(fell, 50):
            reach = [k for k in kept.tolist() if k < r and tile[k] != tile[r] and scans.iou(boxes[:, k], boxes[:, r]) >= least]
            own[r] = reach[0]
        assert all(first[np.searchsorted(fell, r)] == k and value[np.searchsorted(fell, r)] == scans.iou(boxes[:, r], boxes[:, k]) for r, k in own.items())
    assert scans.copies(boxes[:, :0], tile[:0])[0].size == 0


def test_match_lays_truths_in_the_order_of_its_index(monkeypatch):
    """What a detection meets lies side by side in memory: the index's truths are numbered as it holds them."""
    rng = np.random.default_rng(5)
    corner, side = rng.integers(0, 300, (2, 900)).astype(float), rng.integers(20, 60, 900)
    boxes, ids, built = np.concatenate([corner, corner + side]), rng.permutation(900) + 7, []

    class Watched(scans.Near):
        def __init__(self, *given):
            super().__init__(*given)
            built.append(np.concatenate([part[0] for part in self.parts]))

    monkeypatch.setattr(scans, "Near", Watched)
    rows, truths = np.arange(0, 900, 2), np.arange(1, 900, 2)
    took, told = scans.matched(boxes, ids, rows, truths, 0.3, np.zeros(450, bool))
    assert (np.diff(built[1]) > 0).all()

    free = truths.tolist()
    for n, row in enumerate(rows):
        over = [(-float(scans.iou(boxes[:, [row]], boxes[:, [t]])[0]), ids[t], t) for t in free]
        best = min(over)
        assert told[n] == -best[0]
        assert took[n] == (best[2] if -best[0] >= 0.3 else -1)
        if took[n] >= 0:
            free.remove(best[2])


def test_the_thresholds_of_a_tile_are_scanned_side_by_side(monkeypatch):
    rng = np.random.default_rng(41)
    n, m = 3_000, 2_500
    x0, y0, side = rng.integers(0, 160, n + m), rng.integers(0, 160, n + m), rng.integers(6, 14, n + m)
    conf = pa.array([None if i >= n or i % 50 == 0 else float(c) for i, c in enumerate(rng.integers(0, 40, n + m))], pa.float64())
    corners = {c: pa.array(v.astype(float)) for c, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x0 + side, y0 + side), strict=True)}
    scene = pa.table({"tile": pa.array(np.zeros(n + m, int)), "id": rng.permutation(n + m), "conf": conf, **corners, "truth": np.arange(n + m) >= n})
    looked = []

    class Watched(scans.Near):
        def pairs(self, *args):
            for i, j in super().pairs(*args):
                looked.append(len(i))
                yield i, j

    monkeypatch.setattr(scans, "Near", Watched)
    told = matching._hits(matching.THRESHOLDS)(scene)
    together = sum(looked)
    looked.clear()
    matching._hits(matching.THRESHOLDS[:1])(scene)
    assert together < 3 * sum(looked)  # before: each threshold looked anew
    boxes, ids, rows, _, truths, _ = matching._arrays(scene)
    for i, least in enumerate(matching.THRESHOLDS):
        free, want = set(truths.tolist()), []
        value = scans.iou(boxes[:, rows][:, :, None], boxes[:, truths][:, None, :])
        for r in range(len(rows)):
            near = [(-value[r, t], ids[truths[t]], truths[t]) for t in np.nonzero(value[r] >= least)[0] if truths[t] in free]
            want.append(bool(near))
            if near:
                free.remove(min(near)[2])
        assert told[f"t{i}"].to_pylist() == want and any(want)
        assert (scans.matched(boxes, ids, rows, truths, least)[0] >= 0).tolist() == want
