"""Quality by a factorisation machine.

Features of a text are its distinct words, hashed, statistics of its structure, and its length as stated in the table's
metadata. Beside a weight, every feature has a short vector, and each pair of features interacts by the product of
theirs; the sum over all pairs comes in linear time as half the square of the sum less the sum of squares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import Memo, check_new, held_out, read, slices, training_rows

#: Labelled rows that the machine is fitted on at most, half of each label; hashed words; length of the vectors; passes.
SAMPLE_ROWS, BITS, RANK, PASSES = 3_000, 15, 6, 30
GOOD_AT = 0.7

MARKS = regex.compile(r"[^\p{L}\p{N}\s]")
NUMBERS = regex.compile(r"\p{N}")
UPPER = regex.compile(r"\p{Lu}")
STATISTICS = 12


def hashed(word: str) -> int:
    """A word's feature: words of letters alone and words with marks fall into one table."""
    return crc32(word.lower().encode("utf-8", "surrogatepass")) & (1 << BITS) - 1


def structure(text: str, words: list[str], distinct: int, stated: int | None) -> list[float]:
    """Statistics of a text's structure, each about 0 to 3, and its length as stated, or as it is where that is null."""
    n, lines = max(len(text), 1), text.split("\n")
    count = max(len(words), 1)
    return [
        len(MARKS.findall(text)) / n * 10,
        len(NUMBERS.findall(text)) / n * 10,
        len(UPPER.findall(text)) / n * 10,
        np.log1p(len(words)) / 4,
        sum(map(len, words)) / count / 6,
        distinct / count,
        1 - len(set(lines)) / len(lines),
        len(lines) / count * 5,
        text.count("|") / count,
        min(max(map(len, words), default=0) / 20, 3.0),
        min(sum(1 for line in lines if line.rstrip().endswith((".", "!", "?"))) / len(lines), 1.0),
        np.log1p(len(text) if stated is None or stated < 0 else stated) / 6,
    ]


@dataclass
class Machine:
    """Weights and vectors: words first, then the statistics."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def score(self, words: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(words, stats)[0], -30, 30)))

    def raw(self, words: list[np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value and sum of vectors of each text; a word's x is one over the root of the number of distinct words."""
        k, base = self.vectors.shape[1], 1 << BITS
        sizes = np.array([len(w) for w in words], np.int64)
        x = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
        flat = np.concatenate([*words, np.zeros(0, np.int64)]).astype(np.int64)
        linear, total, squares = np.zeros(len(words)), np.zeros((len(words), k)), np.zeros((len(words), k))
        full = np.nonzero(sizes)[0]
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            linear[full] = np.add.reduceat(self.weights[flat] * x, starts)
            xv = self.vectors[flat] * x[:, None]
            total[full] = np.add.reduceat(xv, starts)
            squares[full] = np.add.reduceat(xv * xv, starts)
        z = (stats - self.mean) / self.spread
        linear += z @ self.weights[base:]
        total += z @ self.vectors[base:]
        squares += (z * z) @ (self.vectors[base:] ** 2)
        return self.bias + linear + 0.5 * (total * total - squares).sum(1), total


def read_text(text: str, stated: int | None, word: Memo) -> tuple[np.ndarray, list[float]]:
    """The distinct words' features and the statistics of a whole text."""
    words = text.split()
    distinct = set(words)
    return np.unique(np.fromiter(map(word.__getitem__, distinct), np.int64, len(distinct))), structure(text, words, len(distinct), stated)


def fit(texts: list[str], good: list[int], stated: list[int | None] | None = None, passes: int = PASSES, seed: int = 7) -> Machine:
    """Stochastic gradient with a step size for each weight, in a fixed order; classes count alike in sum.

    stated: the lengths as the metadata state them, None for the texts' own.
    """
    rng = np.random.default_rng(seed)
    memo = Memo(hashed)
    base = 1 << BITS
    machine = Machine(0.0, np.zeros(base + STATISTICS), rng.normal(0, 0.05, (base + STATISTICS, RANK)), np.zeros(STATISTICS), np.ones(STATISTICS))
    if not texts:
        return machine
    words, stats = zip(*(read_text(t, n, memo) for t, n in zip(texts, stated or [None] * len(texts), strict=True)), strict=True)
    stats = np.array(stats)
    machine.mean, machine.spread = stats.mean(0), stats.std(0) + 0.05
    y = np.array(good, np.float64)
    share = min(max(y.mean(), 0.02), 0.98)
    weigh = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    speed_w, speed_v, speed_b = np.full(len(machine.weights), 1e-2), np.full(machine.vectors.shape, 1e-2), 1e-2
    own = base + np.arange(STATISTICS)
    size = 32
    for _ in range(passes):
        order = rng.permutation(len(y))
        for i in range(0, len(order), size):
            some = order[i : i + size]
            value, total = machine.raw([words[j] for j in some], stats[some])
            error = (y[some] - 1 / (1 + np.exp(-np.clip(value, -30, 30)))) * weigh[some] / len(some)
            z = (stats[some] - machine.mean) / machine.spread
            feats = np.concatenate([np.concatenate([words[j], own]) for j in some]).astype(np.int64)
            x = np.concatenate([np.concatenate([np.full(len(words[j]), 1 / np.sqrt(max(len(words[j]), 1))), z[r]]) for r, j in enumerate(some)])
            row = np.repeat(np.arange(len(some)), [len(words[j]) + STATISTICS for j in some])
            seen, at = np.unique(feats, return_inverse=True)
            ex = error[row] * x
            dw = np.bincount(at, ex, minlength=len(seen)) - 1e-4 * machine.weights[seen]
            each = ex[:, None] * (total[row] - machine.vectors[feats] * x[:, None])
            dv = np.stack([np.bincount(at, each[:, k], minlength=len(seen)) for k in range(RANK)], 1) - 1e-3 * machine.vectors[seen]
            speed_w[seen] += dw * dw
            speed_v[seen] += dv * dv
            speed_b += error.sum() ** 2
            machine.weights[seen] += 0.1 * dw / np.sqrt(speed_w[seen])
            machine.vectors[seen] += 0.05 * dv / np.sqrt(speed_v[seen])
            machine.bias += 0.1 * error.sum() / np.sqrt(speed_b)
    return machine


def scored_by(told: Callable, text_at: int, stated_at: int | None, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Machine = told()
        memo = Memo(hashed, 600_000)
        for batch in slices(batches, text_at):
            stated = [None] * batch.num_rows if stated_at is None else batch.column(stated_at).to_pylist()
            words, stats = zip(*(read_text(t.as_py() or "", n, memo) for t, n in zip(batch.column(text_at), stated, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(machine.score(list(words), np.array(stats)))], names)

    return run


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text", stated_col: str | None = None, name: str = "score") -> DataFrame:
    """docs with the score of each whole text, 0 to 1.

    Null and empty texts have no words; their score comes from the statistics alone. stated_col is an integer column
    with the length as the metadata state it, null for the text's own. Rows that repeat score alike; other columns come
    along and are no input; name must be a new one, or it is an error.
    """
    check_new(docs, name)
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index(stated_col) if stated_col else None
    return docs.mapInArrow(scored_by(lambda: sent.value, docs.columns.index(text_col), at, schema.names), schema)


def trained(spark: SparkSession, sf_dir: str, rows: int = SAMPLE_ROWS) -> Machine:
    """The machine for a folder of tables: labelled rows outside the held-out fold, at most rows of them."""
    return fit(*training_rows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "quality", rows, "n_chars"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    found = score(docs, trained(spark, sf_dir), stated_col="n_chars")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD_AT).cast("int").alias("predicted"))
