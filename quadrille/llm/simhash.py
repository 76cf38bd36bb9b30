"""Near-duplicates by SimHash fingerprints, whose pairs are found by vantage-point trees.

Two fingerprints that differ in at most four bits differ, in one of four bands of their bits, by no more than that
band's radius: one bit in the first or none in another. Each band has a vantage-point tree, whose inner nodes split
fingerprints by their Hamming distance to a vantage point and whose leaves are the shards. A fingerprint lives in one
shard of each band, and by the triangle bound it also visits those whose boundary lies within the radius. Of a pair,
one has to visit the other, so only the outer side of a boundary visits the inner one. With radius 0 nothing visits,
and a tree is a partition by the band alone. Inside a shard all differing bits are counted, so the pairs are exact.

A shard that outgrows its bound is split by the same means: whatever its band, its pairs differ in at most four of the
other bits, which have four bands and trees of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import fresh, hash_sample, quoted, read, slices, spread_join, written
from quadrille.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Radii of the bands, which and 1 each add up to more than DISTANCE, and how much longer than the others the first is.
RADII, LONGER = (1, 0, 0, 0), 4
#: Fingerprints that the trees are fitted on, and those that live in a shard on average and before it is split.
TREE_SAMPLE, SHARD_ROWS, SPLIT_ROWS = 16_384, 1_024, 32_768
#: Largest block of a shard's own fingerprints and of all that come to it; larger shards are many pairs of blocks.
OWN_BLOCK, ALL_BLOCK = 1_024, 4_096


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over the XXH64 of the word shingles, repeats included; 0 where there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), ">u8").astype("<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 100_000):
        ones += np.unpackbits(hashes[i : i + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(found)], ["id", "h", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp) of each row, h a hash of the text that tells rows of one id apart."""
    rows = docs.select(quoted(id_col).cast("long").alias("id"), F.xxhash64(quoted(text_col)).alias("h"), quoted(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, "id long, h long, fp long")


def bands(bits: int) -> list[int]:
    """Masks that part the set bits among the bands, in their order."""
    places = [i for i in range(64) if bits >> i & 1]
    short = max(1, (len(places) - LONGER) // len(RADII))
    ends = [len(places) - short * k for k in range(len(RADII) - 1, -1, -1)]
    return [sum(1 << i for i in places[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


class Tree:
    """A vantage-point tree over the bits of a mask; its leaves are numbered from first_leaf."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, leaf_rows: int, first_leaf: int):
        self.bits, self.mask, self.radius = mask, np.uint64(mask), radius
        self.leaves, self.first_leaf = 0, first_leaf
        self.root = self.grow(sample & self.mask, max(1, leaf_rows), np.random.default_rng(first_leaf))

    def grow(self, values: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> tuple | int:
        if len(values) > leaf_rows:
            for point in rng.choice(values, min(4, len(values)), replace=False):
                away = np.bitwise_count(values ^ point)
                inside = away <= (middle := int(np.median(away)) - (np.median(away) == away.max()))
                if 0 < inside.sum() < len(values):
                    return point, middle, self.grow(values[inside], leaf_rows, rng), self.grow(values[~inside], leaf_rows, rng)
        self.leaves += 1
        return self.first_leaf + self.leaves - 1

    def route(self, fps: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows that come to it, whether it is their home); rows for which home is false only visit.

        Of two rows at home that a boundary parts, the outer one visits the inner side; visitors go to both.
        """
        values = fps & self.mask
        open_ = [(self.root, np.arange(len(fps)), home)]
        while open_:
            node, rows, own = open_.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows, own
                continue
            point, middle, near, far = node
            away = np.bitwise_count(values[rows] ^ point).astype(np.int64)
            inside = away <= middle + self.radius
            outside = away > np.where(own, middle, middle - self.radius)
            open_.append((near, rows[inside], own[inside] & (away[inside] <= middle)))
            open_.append((far, rows[outside], own[outside]))


def forest(sample: np.ndarray, rows: int, bits: int = 2**64 - 1) -> list[Tree]:
    """A tree for each band of the bits; a shard has about SHARD_ROWS of so many rows, and at least four of the sample."""
    sample = np.unique(sample.astype(np.uint64) & np.uint64(bits))
    share = max(4, int(len(sample) * SHARD_ROWS / max(rows, 1)))
    trees: list[Tree] = []
    for mask, radius in zip(bands(bits), RADII, strict=True):
        trees.append(Tree(sample, mask, radius, share, sum(t.leaves for t in trees)))
    return trees


def _routed(trees: list[Tree]) -> Callable:
    """Rows (fp) to (leaf, fp, home)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("fp").to_numpy(zero_copy_only=False)
            yield from _came(signed, np.ones(len(signed), bool), trees, lambda rows: 0)

    return run


def _split(sample: np.ndarray, trees: list[Tree], largest: int) -> Callable:
    """Rows (leaf, fp, home) of shards that are split to the same of their parts."""
    below = [forest(sample, largest, 2**64 - 1 - t.bits) for t in trees]
    ends = np.cumsum([t.leaves for t in trees])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, signed, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "fp", "home"))
            for i, parts in enumerate(below):
                some = np.nonzero(np.searchsorted(ends, leaf, side="right") == i)[0]
                yield from _came(signed[some], home[some], parts, lambda rows, some=some: (leaf[some][rows] + 1) << 24)

    return run


def _came(signed: np.ndarray, home: np.ndarray, trees: list[Tree], base: Callable) -> Iterator[pa.RecordBatch]:
    found = [(base(rows) + number + np.zeros(len(rows), np.int64), signed[rows], own) for tree in trees for number, rows, own in tree.route(signed.view(np.uint64), home)]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["leaf", "fp", "home"])


def _near(own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint of the two blocks that has a pair across them, with the smallest that its pairs lead to."""
    close = np.empty((len(own), len(others)), bool)
    for i in range(0, len(own), 128):
        close[i : i + 128] = np.bitwise_count(own[i : i + 128, None] ^ others[None, :]) <= DISTANCE
    close &= own[:, None] != others[None, :]
    rows, cols = close.any(1), close.any(0)
    own, others, close = own[rows], others[cols], close[rows][:, cols]
    nodes, at = np.unique(np.concatenate([own, others]), return_inverse=True)
    mine, theirs = at[: len(own)], at[len(own) :]
    label = np.arange(len(nodes))
    while len(nodes):
        before = label.copy()
        reached = np.where(close, label[theirs][None, :], len(nodes)).min(1)
        np.minimum.at(label, mine, reached)
        reached = np.where(close, label[mine][:, None], len(nodes)).min(0)
        np.minimum.at(label, theirs, reached)
        label = label[label]
        if (label == before).all():
            break
    return nodes, nodes[label]


def _pairs(table: pa.Table) -> pa.Table:
    fp, own = table.column("fp").to_numpy().view(np.uint64), table.column("own").to_numpy(zero_copy_only=False)
    nodes, least = _near(fp[own], fp[~own])
    apart = nodes != least
    return pa.table({"a": pa.array(nodes[apart].view(np.int64)), "b": pa.array(least[apart].view(np.int64))})


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what differs in at most DISTANCE bits, from distinct fingerprints (fp).

    In a pair of blocks each fingerprint that has a pair comes once, with the smallest its pairs there lead to: the
    same components as all pairs would give, and no more rows than fingerprints came. The sample on the driver has at
    most TREE_SAMPLE fingerprints, which bounds the trees and the tables of shard sizes that are broadcast.
    """
    rows = distinct.count()
    sample = np.array([r[0] for r in hash_sample(distinct, TREE_SAMPLE, "fp").collect()], np.int64).view(np.uint64)
    trees, kind = forest(sample, rows), "leaf long, fp long, home boolean"
    routed = distinct.select("fp").mapInArrow(_routed(trees), kind)
    counted = lambda f: f.groupBy("leaf").agg(F.count_if("home").alias("own"), F.count("*").alias("all"))
    sizes = written(counted(routed), "shards")
    large = sizes.where(F.col("own") > SPLIT_ROWS).select("leaf")
    if (largest := sizes.agg(F.max("own")).first()[0] or 0) > SPLIT_ROWS:
        parts = routed.join(F.broadcast(large), "leaf", "left_semi").mapInArrow(_split(sample, trees, largest), kind)
        routed = routed.join(F.broadcast(large), "leaf", "left_anti").unionAll(parts)
        sizes = sizes.join(F.broadcast(large), "leaf", "left_anti").unionAll(counted(parts))
    blocks = sizes.select("leaf", F.ceil(F.col("own") / OWN_BLOCK).cast("int").alias("na"), F.ceil(F.col("all") / ALL_BLOCK).cast("int").alias("nb")).where("na > 0")
    placed = routed.join(blocks, "leaf") if largest > SPLIT_ROWS else routed.join(F.broadcast(blocks), "leaf")
    placed = placed.withColumn("hash", F.xxhash64("fp"))
    block = lambda n: F.pmod(F.col("hash"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = placed.where("home").select("leaf", block("na").alias("i"), every("nb").alias("j"), "fp", F.lit(True).alias("own"))
    come = placed.select("leaf", every("na").alias("i"), block("nb").alias("j"), "fp", F.lit(False).alias("own"))
    return home.unionAll(come).groupBy("leaf", "i", "j").applyInArrow(_pairs, "a long, b long").distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root, first, n): of each distinct fingerprint its component, the first row there, by id, then h, and its own rows.

    first is a struct (missing, id, h, n), n the rows that equal it in id and h; null ids come after all others.
    """
    row = F.struct(F.col("id").isNull().alias("missing"), "id", "h")
    counted = prints.groupBy("fp", "id", "h").agg(F.count("*").alias("n"))
    distinct = written(counted.groupBy("fp").agg(F.min(F.struct(*(row[k].alias(k) for k in ("missing", "id", "h")), "n")).alias("first"), F.sum("n").alias("n")), "fingerprints")
    joined = components(links(distinct), "simhash")
    rooted = distinct.select("fp", "first").join(joined.withColumnRenamed("node", "fp"), "fp")
    tops = rooted.groupBy("root").agg(F.min("first").alias("top"), F.count("*").alias("n"))
    found = spread_join(rooted, tops.drop("n"), "root", F.col("fp"), tops, distinct.count()).select("fp", "root", "top")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("top", "first").alias("first"), "n")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row.

    Null texts are empty texts, whose fingerprint is 0. component_id is the smallest id that links reach, null only
    where all of them are null. Repeated rows come as often as they are there; an empty table gives no rows. Other
    columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col), "simhash")
    told = written(classes(prints), "simhash-classes")
    found = spread_join(prints, told.select("fp", "first"), "fp", F.struct("id", "h"), told.select("fp", "n"), prints.count())
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.id").alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the one with the smallest id.

    Ties in the id are broken by a hash of the text; of rows that repeat both, one stays.
    """
    prints = written(fingerprints(docs, id_col, text_col), "simhash")
    firsts = classes(prints).select("first.id", "first.h", "first.n").distinct()
    kid, h, many = fresh(docs, "id", "h", "n")
    kept = written(firsts.select(F.col("id").alias(kid), F.col("h").alias(h), F.col("n").alias(many)), "simhash-kept")
    keyed = docs.withColumn(h, F.xxhash64(quoted(text_col))).withColumn(kid, quoted(id_col).cast("long"))
    alike = lambda right: (keyed[h] == right[h]) & keyed[kid].eqNullSafe(right[kid])
    one, more = kept.where(F.col(many) == 1), kept.where(F.col(many) > 1)
    once = keyed.join(one, alike(one), "left_semi")
    several = keyed.join(more, alike(more), "left_semi").dropDuplicates([kid, h])
    return once.unionAll(several).select(*map(quoted, docs.columns))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))
