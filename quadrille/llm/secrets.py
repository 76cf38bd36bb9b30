"""Secret scans, in DataFrame operations only.

Fixed patterns find the base spans. Beside them, long tokens are scored by two first-order Markov models of
characters, one of random strings and one of ordinary identifiers; a token whose log-likelihood ratio a character
speaks for the random model is a span of its own. Both models are counted from labelled samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import hash_sample, quoted, read

# The patterns of the base spans, in the order of their kinds, with what a match needs to count.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

#: Characters of the models, in the order of their rows; all others share the row after the last.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A token that the models judge, and the least log-likelihood ratio a transition.
CANDIDATE, THRESHOLD = r"[A-Za-z0-9+/_=-]{20,}", 1.0
#: Rows of documents whose words are the sample of identifiers, and random strings of each form.
SAMPLE_DOCS, SAMPLE_STRINGS = 200, 1_000

SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, value), in code points.

    split() gives the stretches between the matches and regexp_extract_all() the matches, from which the offsets
    follow; texts without a match cost one search.
    """
    return _located(text, pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), None)


def _located(text: Column, pattern: str, found: Column, values: Column | None) -> Column:
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("all"), (found if values is None else values).alias("value"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,value:string>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + part["gap"]
        end = begin + F.length(part["all"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), part["value"].alias("value")))).alias("out"))

    walked = F.aggregate(F.filter(parts, lambda p: p["all"].isNotNull()), start, step)["out"]
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def assignments(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))
    return F.filter(_located(text, ASSIGN, found, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))), lambda m: F.length(m["value"]) >= ASSIGN_LEAST)


def runs(text: Column, one: str, least: int, begin: str = "") -> Column:
    """Matches of begin, then one or more of a character class, that have at least so many characters.

    A match ends where the class ends, and what begins inside it is shorter, so asking for the length at once gives
    the same matches as dropping the short ones does.
    """
    return matches(text, f"{begin}{one}{{{least - len(begin)},}}")


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """Labelled strings (value, random): what the two models are counted from.

    Random: hexadecimal digits in either case, base 64 and its letters and digits alone, made from digests of numbers.
    Ordinary: words of at least six letters from a sample of documents, bounded by sample_docs and chosen by a hash of
    the id, alone and joined as identifiers join them.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    made = spark.range(strings).select(F.explode(F.array(digest, F.upper(digest), base64, F.translate(base64, "+/=", ""), F.upper(F.translate(base64, "+/=", "")))).alias("value"), F.lit(True).alias("random"))
    text = F.coalesce(quoted(text_col), F.lit(""))
    words = hash_sample(docs.select(quoted(id_col).alias("id"), text.alias("text")), sample_docs, "id").select(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{6,}"), F.lit(0)).alias("w"))
    pair = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0))), lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b")))
    joined = F.flatten(F.transform(pair, lambda p: F.array(F.concat_ws("_", p["a"], p["b"]), F.concat_ws("-", p["a"], p["b"]), F.concat(p["a"], F.initcap(p["b"])), F.concat_ws("/", p["a"], p["b"]), p["a"])))
    ordinary = words.where(F.size("w") > 0).select(F.explode(joined).alias("value"), F.lit(False).alias("random")).where(F.col("value").isNotNull())
    return made.unionAll(ordinary)


def transitions(samples: DataFrame) -> DataFrame:
    """Log-likelihood ratio, random over ordinary, of every transition: (at, llr), at = row of the models' table.

    Both models are smoothed by half a count a cell. 68 by 68 rows: a transition that neither sample has tells nothing
    and counts 0, so that lines of dashes, say, are no random strings.
    """
    side = len(ALPHABET) + 1
    steps = F.sequence(F.lit(1), F.length("value") - 1)
    pairs = samples.where(F.length("value") > 1).select("random", F.explode(F.transform(steps, lambda i: _cell(F.col("value"), i))).alias("at"))
    counted = pairs.groupBy("at").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    every = samples.sparkSession.range(side * side).select(F.col("id").cast("int").alias("at")).join(counted, "at", "left")
    rows = every.select("at", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("r", "o")), F.floor(F.col("at") / side).alias("row"))
    whole = Window.partitionBy("row")
    ratio = lambda n: F.log((F.col(n) + 0.5) / (F.sum(n).over(whole) + 0.5 * side))
    return rows.select("at", F.when(F.col("r") + F.col("o") > 0, ratio("r") - ratio("o")).otherwise(0.0).alias("llr"))


def _place(char: Column) -> Column:
    """0-based row of a character; characters outside the alphabet have the last."""
    at = F.instr(F.lit(ALPHABET), char)
    return F.when(at > 0, at - 1).otherwise(len(ALPHABET))


def _cell(value: Column, i: Column) -> Column:
    return _place(F.substring(value, i, F.lit(1))) * (len(ALPHABET) + 1) + _place(F.substring(value, i + 1, F.lit(1)))


def score(value: Column, model: Column) -> Column:
    """Mean log-likelihood ratio over the transitions of a string."""
    steps = F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.get(model, _cell(value, i).cast("int")))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.size(steps)


def fitted(samples: DataFrame) -> Column:
    """The models as one constant array; 68 by 68 numbers come to the driver."""
    table = [llr for _, llr in sorted(transitions(samples).collect())]
    return F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")


def scan(docs: DataFrame, model: Column, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the spans of each text: a column `spans` of (start, rank, kind, end, value), ordered by start, then kind.

    Kinds: assign, access, hex (fixed patterns) and random (the models). Offsets count code points, end exclusive.
    Random spans do not overlap a base span. Null and empty texts have no spans; texts are read whole. An added
    column of a name that docs has replaces it, so pass the columns wanted.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))

    def ranked(found: Column, rank: int, kind: str) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    base = {
        "assign": ranked(assignments(text), 0, "assign"),
        "access": ranked(runs(text, "[A-Z0-9]", ACCESS_LEAST, "AKIA"), 1, "access"),
        "hex": ranked(runs(text, "[0-9a-f]", HEX_LEAST), 2, "hex"),
    }
    found = docs.withColumns(base).withColumn("base", F.array_sort(F.concat(*map(F.col, base)))).withColumn("candidates", matches(text, CANDIDATE))
    apart = lambda m: ~F.exists(F.col("base"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    judged = F.filter(F.col("candidates"), lambda m: F.when(apart(m), score(m["value"], model) >= threshold).otherwise(False))
    added = found.withColumn("random", F.when(F.size("candidates") > 0, ranked(judged, 3, "random")).otherwise(F.array().cast(SPAN)))
    return added.withColumn("spans", F.array_sort(F.concat("base", "random"))).drop("candidates")


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan(docs, fitted(labelled_samples(docs)))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), F.size("random").cast("long").alias("n_random"))
