"""Queries that audit tables, and queries over reviewed selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import boxes as B
from quadrille.operators import audit, grouping, selection, tiles
from quadrille.plans import geography, inputs as I


def q_audit(spark, sf):
    """Facts that the tables must meet, and one that they do not."""
    o = audit.required(I.objects(spark, sf), ["id", "x0", "y0", "x1", "y1", "area"])
    bad = F.col("x0").isNull() | (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    checks = {
        "ids_unique": audit.unique("id"),
        "boxes_valid": F.count_if(bad) == 0,
        "areas_positive": F.min("area") > 0,
        "inside_scene": (F.min("x0") >= 0) & (F.max("y1") <= I.TOP + 300),
        "three_states": F.count_distinct("status") == 3,
        "states_known": F.size(F.array_except(F.collect_set("status"), F.array(F.lit("F"), F.lit("O"), F.lit("P")))) == 0,
        "no_owner_zero": F.count_if(F.col("owner") == 0) == 0,
        "too_few": F.count("*") < 10,
    }
    return audit.expectations(o, checks)


def q_references(spark, sf):
    """Rows whose key the other table lacks, both ways."""
    docs, labels = I.read(spark, sf, "documents").select("doc_id"), I.read(spark, sf, "labels").select("doc_id")
    lacking = lambda a, b, name: a.join(b, "doc_id", "left_anti").agg(F.lit(name).alias("direction"), F.count("*").alias("missing"))
    return lacking(docs, labels, "documents without labels").unionAll(lacking(labels, docs, "labels without documents"))


def q_file_diff(spark, sf):
    """Stems of files that one of two folders lacks."""
    name = F.concat(F.lit("/data/tiles/tile_"), F.col("doc_id").cast("string"), F.lit(".png"))
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
    images = I.read(spark, sf, "documents").select(stem(name).alias("stem"))
    labels = I.read(spark, sf, "labels").select(F.concat(F.lit("tile_"), F.when(F.col("doc_id") % 10 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).cast("string")).alias("stem"))
    return audit.file_differences(images, labels, "stem")


def lines(spark, sf):
    """Label lines, some broken, built from parts."""
    p = I.read(spark, sf, "part")
    k = F.col("p_partkey")
    num = lambda c: c.cast("string")
    good = F.concat_ws(" ", F.lit("0"), num((k % 90 + 5) / 100.0), num((k % 80 + 10) / 100.0), num((k % 9 + 1) / 100.0), num((k % 7 + 1) / 100.0))
    line = (
        F.when(k % 17 == 0, F.concat(good, F.lit(" 1")))
        .when(k % 17 == 1, F.concat(F.lit("1"), F.substr(good, F.lit(2))))
        .when(k % 17 == 2, F.lit("0 a 0.5 0.1 0.1"))
        .when(k % 17 == 3, F.lit("0 1.5 0.5 0.1 0.1"))
        .when(k % 17 == 4, F.lit("0 0.5 0.5 0 0.1"))
        .when(k % 17 == 5, F.lit("0 0.99 0.5 0.1 0.1"))
        .when(k % 17 == 6, F.lit("0 NaN 0.5 0.1 0.1"))
        .otherwise(good)
    )
    return p.select((k % 50).alias("tile"), k.alias("id"), line.alias("line"))


def q_label_lint(spark, sf):
    """Lines a tile by fault, and tiles whose number of good lines is not what their index says."""
    told = audit.lint(lines(spark, sf)).groupBy("tile").agg(F.count("*").alias("lines"), *(F.count_if(F.col("fault") == f).alias(f"n_{f}") for f in ("tokens", "class", "number", "centre", "size", "corner")), F.count_if(F.col("fault").isNull()).alias("good"))
    return told.withColumn("mismatch", F.col("good") != F.col("lines"))


def q_label_text(spark, sf):
    """The label file of each tile that has one: its lines and size."""
    text = tiles.label_text(tiles.labels(geography.grid(spark), I.split_objects(spark, sf), cell=geography.CELL))
    return text.select("tile_name", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.length("text").cast("long").alias("characters"))


def q_bool_decode(spark, sf):
    """Booleans as text, decoded by a map; what it does not hold stays null."""
    c = I.read(spark, sf, "customer")
    text = F.element_at(F.array(*map(F.lit, ("True", "False", "true", "false", "1.0"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    decode = F.create_map(*(F.lit(x) for x in ("True", True, "False", False, "true", True, "false", False)))
    told = c.select(text.alias("raw"), F.try_element_at(decode, text).alias("flag"))
    return told.groupBy("raw").agg(F.count("*").alias("rows"), F.count_if("flag").alias("yes"), F.count_if(F.col("flag").isNull()).alias("unknown"))


def q_json_props(spark, sf):
    """The number inside each event's JSON document, by kind of event."""
    e = I.read(spark, sf, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("rows"), F.sum("k").alias("total"), F.max("k").alias("largest"))


def q_argmax(spark, sf):
    """Each nation's customer of the largest balance, the smallest key first, and the last customer."""
    c = I.read(spark, sf, "customer")
    c = c.toDF(*(x.strip() for x in c.columns))
    return c.groupBy("c_nationkey").agg(*grouping.argmax(c, "c_acctbal", "c_custkey", ["c_custkey", "c_acctbal"]), F.max_by("c_acctbal", "c_custkey").alias("last_acctbal"))


def q_qc_lock(spark, sf):
    """A selection of 24 in each tile through review: exclusions, refill, lock, new ranks."""
    order = [F.col("conf").desc_nulls_last(), F.col("id")]
    pool = I.detections(spark, sf).select("tile", "id", "conf")
    first = selection.top(pool, 24, order, ["tile"])
    reviewed = first.withColumn("decision", F.when(F.col("id") % 5 == 0, selection.EXCLUDE).otherwise(selection.KEEP))
    filled = selection.refilled(reviewed, pool, 24, order, by=["tile"])
    return selection.locked(filled, order, by=["tile"]).select("tile", "id", "conf", F.col("final_rank").cast("long").alias("final_rank"), "decision")


def q_upsert(spark, sf):
    """Suppliers with some replaced and some added; applied twice, which changes nothing."""
    s = I.read(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    news = s.where("s_suppkey % 4 = 0").select(F.when(F.col("s_suppkey") % 8 == 0, F.col("s_suppkey") + 1_000_000).otherwise(F.col("s_suppkey")).alias("s_suppkey"), (F.col("s_acctbal") * 2).alias("s_acctbal"))
    return selection.upserted(selection.upserted(s, news, ["s_suppkey"]), news, ["s_suppkey"])


def q_ratio_defaults(spark, sf):
    """Ratios with null and with zero for an empty denominator."""
    n = I.read(spark, sf, "nation").join(I.read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 9_900).alias("a")), "n_nationkey", "left")
    part = F.coalesce("a", F.lit(0)).cast("double")
    return n.select("n_name", F.round(B.ratio(part, F.col("n").cast("double")), 6).alias("share"), F.round(B.ratio(F.lit(1.0), part), 6).alias("inverse"), F.try_divide(F.lit(1.0), part).isNull().alias("undefined"))


QUERIES = {f.__name__: f for f in (q_audit, q_references, q_file_diff, q_label_lint, q_label_text, q_bool_decode, q_json_props, q_argmax, q_qc_lock, q_upsert, q_ratio_defaults)}

LINES = """ln AS (
  SELECT k % 50 AS tile, k, CASE k % 17 WHEN 0 THEN 'tokens' WHEN 1 THEN 'class' WHEN 2 THEN 'number' WHEN 3 THEN 'centre' WHEN 4 THEN 'size' WHEN 5 THEN 'corner' WHEN 6 THEN 'number' END AS fault FROM (SELECT p_partkey AS k FROM part)
)"""

ORACLES = {
    "q_audit": f"""WITH {I.OBJECTS}, c AS (SELECT count(*) = count(DISTINCT id) AS ids_unique, count(*) FILTER (x0 IS NULL OR x1 <= x0 OR y1 <= y0) = 0 AS boxes_valid, min(area) > 0 AS areas_positive, min(x0) >= 0 AND max(y1) <= {I.TOP + 300} AS inside_scene,
  count(DISTINCT status) = 3 AS three_states, count(*) FILTER (status NOT IN ('F', 'O', 'P')) = 0 AS states_known, count(*) FILTER (owner = 0) = 0 AS no_owner_zero, count(*) < 10 AS too_few FROM obj),
r AS (UNPIVOT c ON COLUMNS(*) INTO NAME "check" VALUE passed)
SELECT "check", passed FROM r UNION ALL SELECT 'all', bool_and(passed) FROM r""",
    "q_references": """SELECT 'documents without labels' AS direction, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'labels without documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "q_file_diff": """WITH a AS (SELECT DISTINCT 'tile_' || doc_id AS stem FROM documents), b AS (SELECT DISTINCT 'tile_' || CASE WHEN doc_id % 10 = 0 THEN -doc_id - 1 ELSE doc_id END AS stem FROM labels)
SELECT stem, 'first' AS side FROM a WHERE stem NOT IN (SELECT stem FROM b) UNION ALL SELECT stem, 'second' FROM b WHERE stem NOT IN (SELECT stem FROM a)""",
    "q_label_lint": f"""WITH {LINES} SELECT tile, count(*) AS lines, count(*) FILTER (fault = 'tokens') AS n_tokens, count(*) FILTER (fault = 'class') AS n_class, count(*) FILTER (fault = 'number') AS n_number, count(*) FILTER (fault = 'centre') AS n_centre,
  count(*) FILTER (fault = 'size') AS n_size, count(*) FILTER (fault = 'corner') AS n_corner, count(*) FILTER (fault IS NULL) AS good, count(*) FILTER (fault IS NULL) <> count(*) AS mismatch FROM ln GROUP BY tile""",
    "q_label_text": f"""WITH {geography.SEEN}, {geography.LAB} SELECT tile_name, count(*) AS lines, count(*) * 38 - 1 AS characters FROM (SELECT tile_name FROM lab) GROUP BY tile_name""",
    "q_bool_decode": """WITH t AS (SELECT ['True', 'False', 'true', 'false', '1.0'][c_custkey % 5 + 1] AS raw FROM customer)
SELECT raw, count(*) AS rows, count(*) FILTER (lower(raw) = 'true') AS yes, count(*) FILTER (raw = '1.0') AS unknown FROM t GROUP BY raw""",
    "q_json_props": """WITH e AS (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k FROM events) SELECT event_type, count(k) AS rows, sum(k)::BIGINT AS total, max(k) AS largest FROM e GROUP BY event_type""",
    "q_argmax": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS z FROM customer)
SELECT c_nationkey, max(c_custkey) FILTER (a = 1) AS best_c_custkey, max(c_acctbal) FILTER (a = 1) AS best_c_acctbal, max(c_acctbal) FILTER (z = 1) AS last_acctbal FROM r GROUP BY c_nationkey""",
    "q_qc_lock": f"""WITH {I.DETECTIONS}, f AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY conf DESC NULLS LAST, id) AS n FROM det), k AS (SELECT * FROM f WHERE n <= 24 AND id % 5 <> 0), kn AS (SELECT tile, count(*) AS kept FROM k GROUP BY tile),
x AS (SELECT f.* FROM f LEFT JOIN kn USING (tile) WHERE n > 24 AND n - 24 <= 24 - coalesce(kept, 0)), a AS (SELECT tile, id, conf FROM k UNION ALL SELECT tile, id, conf FROM x)
SELECT tile, id, conf, row_number() OVER (PARTITION BY tile ORDER BY conf DESC NULLS LAST, id) AS final_rank, 'keep' AS decision FROM a""",
    "q_upsert": """WITH n AS (SELECT CASE WHEN s_suppkey % 8 = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END AS s_suppkey, s_acctbal * 2 AS s_acctbal FROM supplier WHERE s_suppkey % 4 = 0)
SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM n) UNION ALL SELECT * FROM n""",
    "q_ratio_defaults": """WITH c AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal > 9900) AS a FROM customer GROUP BY c_nationkey)
SELECT n_name, coalesce(round(coalesce(a, 0)::DOUBLE / nullif(n, 0), 6), 0.0) AS share, coalesce(round(1.0::DOUBLE / nullif(coalesce(a, 0), 0), 6), 0.0) AS inverse, coalesce(a, 0) = 0 AS undefined FROM nation LEFT JOIN c ON c_nationkey = n_nationkey""",
}
