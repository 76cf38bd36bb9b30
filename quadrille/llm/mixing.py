"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. Within a source, documents are dealt to ranges of the key; the ranges' word
counts give each range its offset, and inside a range a running sum continues from it. So the prefix sums of a source
come from many tasks, however large the source. A source's budget is whole epochs of all its documents and then a cut
in the order of the keys, exact to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import WORD, fresh, quoted, read, written

#: Documents that a range of keys holds on average, and ids whose copies have keys of their own at most.
RANGE_ROWS, HOT_IDS = 1_000, 10_000


def words(text: Column) -> Column:
    """Words of a text, null as 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Water-filling over sources (key, label, source_size): adds target.

    Sources in code-point order, null last, weigh the given numbers in turn and share the total of all sizes. A target
    stops at cap times its source's size and the rest is shared by weight again, which ends where all that are below
    their cap have one level a weight: the largest of the levels that each prefix of sources, ordered by cap over
    weight, would leave. One row a source goes through one task, after aggregation.
    """
    everything = Window.orderBy(F.col("label").asc_nulls_last())
    rank = (F.row_number().over(everything) - 1) % len(weights)
    ranked = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), rank + 1).cast("double")).withColumn("cap", F.col("source_size") * cap)
    order = [F.col("cap") / F.col("w"), F.col("label").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("w").over(after)
    return ranked.withColumn("level", level).withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * F.max("level").over(whole))).select("key", "source_size", "target")


def _numbered(docs: DataFrame, id_col: str, nth: str, total: int) -> DataFrame:
    """docs with a column nth: null, and for rows of an id that would fill ranges by itself their number among equal rows.

    Such an id has more than RANGE_ROWS rows and more than one in HOT_IDS of all. Its rows that are equal in all columns
    are counted, which Spark does inside each partition first, and numbered by exploding the count.
    """
    most = max(RANGE_ROWS, total // HOT_IDS)
    hot, many = fresh([*docs.columns, nth], "hot", "many")
    ids = written(docs.groupBy(quoted(id_col).alias(hot)).agg(F.count("*").alias(many)).where(F.col(many) > most).select(hot), "mix-hot")
    if ids.isEmpty():
        return docs.withColumn(nth, F.lit(None).cast("long"))
    listed = F.broadcast(ids.withColumn(many, F.lit(True)))
    marked = docs.join(listed, quoted(id_col).eqNullSafe(F.col(hot)), "left")
    few = marked.where(F.col(many).isNull()).select(*map(quoted, docs.columns), F.lit(None).cast("long").alias(nth))
    counted = marked.where(F.col(many)).groupBy(*map(quoted, docs.columns)).agg(F.count("*").alias(many))
    return few.unionAll(counted.select(*map(quoted, docs.columns), F.explode(F.sequence(F.lit(1).cast("long"), F.col(many))).alias(nth)))


def mix(docs: DataFrame, size: Column, *, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> tuple[DataFrame, dict[str, str]]:
    """docs with what the mix takes of each row; the names of the added columns, which clash with none of docs.

    Added: size (the given expression), source_size, target, taken (words, repeats counted) and epochs (whole epochs of
    the source). Rows of a source are ordered by the MD5 of the id as text, then id, then size; rows equal in all these
    take interchangeable shares. An id that very many rows repeat, null too, has a key for each of its equal rows, so
    that no range is larger than others. Null sources are one source, after all others. A source whose size is 0 takes
    0, and an empty table gives no rows.
    """
    names = dict(zip(["size", "source_size", "target", "taken", "epochs"], fresh(docs, "size", "source_size", "target", "taken", "epochs"), strict=True))
    key, order, bucket, ahead, nth = fresh(docs, "key", "order", "bucket", "ahead", "nth")
    total = docs.count()
    ranges = max(1, -(-total // RANGE_ROWS))
    source = quoted(source_col)
    digest = F.md5(F.concat(F.coalesce(quoted(id_col).cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("/"), F.col(nth)), F.lit(""))).cast("binary"))
    rows = _numbered(docs, id_col, nth, total).withColumns(
        {
            names["size"]: size,
            key: F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")),
            order: digest,
            bucket: F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * F.lit(ranges).cast("long") / F.lit(2**32)).cast("long"),
        }
    )
    dealt = rows.groupBy(F.col(key).alias("key"), F.col(bucket).alias("bucket")).agg(F.sum(names["size"]).alias("words"))
    label = F.when(F.col("key") != "n", F.expr("substring(key, 2)"))
    told = targets(dealt.groupBy("key").agg(F.sum("words").alias("source_size")).withColumn("label", label), weights, cap)
    so_far = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.withColumn("before", so_far).join(told, "key")
    offsets = offsets.select(
        F.col("key").alias(key),
        F.col("bucket").alias(bucket),
        F.col("before").alias(ahead),
        F.col("source_size").alias(names["source_size"]),
        F.col("target").alias(names["target"]),
    )
    within = Window.partitionBy(key, bucket).orderBy(F.col(order), quoted(id_col), F.col(names["size"])).rowsBetween(Window.unboundedPreceding, -1)
    budget, whole = F.floor(F.col(names["target"])).cast("long"), F.col(names["source_size"])
    epochs = F.when(whole > 0, F.floor(budget / whole)).otherwise(0).cast("long")
    left = budget - F.col(names["epochs"]) * whole - F.col(ahead)
    part = F.least(F.greatest(left, F.lit(0)), F.col(names["size"]))
    ran = rows.join(offsets, [key, bucket]).withColumn(ahead, F.col(ahead) + F.coalesce(F.sum(names["size"]).over(within), F.lit(0)))
    out = ran.withColumn(names["epochs"], epochs).withColumn(names["taken"], (F.col(names["epochs"]) * F.col(names["size"]) + part).cast("long"))
    return out.select(*map(quoted, docs.columns), *names.values()), names


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word and the white space there."""
    space = r"[\x20\x09-\x0D]+"
    leading = F.when(text.rlike(f"^{space}"), 1).otherwise(0)
    parts = F.split(text, space, (n + 1 + leading).cast("int"))
    rest = F.when(F.size(parts) > n + leading, F.length(F.element_at(parts, -1))).otherwise(0)
    return F.substring(text, F.lit(1), F.length(text) - rest)


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself: rows of docs, each as often as its source's epochs ask, the one at the cut shortened to it.

    Documents without words come once for each whole epoch of their source.
    """
    taken, names = mix(docs, words(quoted(text_col)), id_col=id_col, source_col=source_col, weights=weights, cap=cap)
    size, took = F.col(names["size"]), F.col(names["taken"])
    whole = F.when(size > 0, F.floor(took / size)).otherwise(F.col(names["epochs"])).cast("int")
    part = took - whole * size
    copies = (whole + F.when(part > 0, 1).otherwise(0)).cast("int")
    nth, total, rest = fresh(taken, "nth", "copies", "part")
    each = taken.withColumns({total: copies, rest: part}).where(F.col(total) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(total))))
    text = quoted(text_col)
    cut = F.when((F.col(nth) == F.col(total)) & (F.col(rest) > 0), first_words(text, F.col(rest))).otherwise(text)
    return each.withColumn(text_col, cut).select(*map(quoted, docs.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"))
    taken, names = mix(docs, F.col("size"))
    return taken.select("doc_id", "size", *(F.col(names[x]).alias(x) for x in ("source_size", "target", "taken")))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT source, source_size, 3 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS w
  FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r WINDOW o AS (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST)
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, w * max(level) OVER ()) AS target FROM l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t
), p AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs,
    floor(b.target)::BIGINT - b.epochs * b.source_size - coalesce(sum(d.size) OVER (
      PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_over
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(left_over, 0), size))::BIGINT AS taken FROM p
"""
