"""Toxicity by a linear-chain conditional random field over the words of a text.

Each word is clean or toxic. Its features are hashed: the word, its beginnings and its end. Training tokens are
labelled from documents' labels: in a toxic document, the words whose features show up in toxic documents only; in
all others, none. Forward-backward gives each word's marginal; marginals that stand out are joined to spans with their
offsets, and a logistic curve over sums of the marginals makes the document's score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import Memo, check_new, fresh, held_out, quoted, read, slices, training_rows
from quadrille.llm.simhash import fingerprint

#: Labelled rows that the field is fitted on at most, half of each label; hashed features; passes over the sample.
SAMPLE_ROWS, BITS, PASSES = 1_600, 18, 25
#: How unlikely, as a negative logarithm, it must be by chance that a feature's documents are toxic; their share at least.
SURPRISE, LEAST_SHARE = 10.0, 0.97
#: Bits in which the fingerprints of sampled texts differ at most for the texts to count as one.
COPY_BITS = 10
#: A word's marginal for it to be in a span, a document's score for it to be toxic, and the marginal that counts as 0.
SPAN_AT, TOXIC_AT, FLOOR = 0.5, 0.3, 0.3

EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself, its first three, four and five letters and its last three."""
    w = EDGES.sub("", word.lower())
    named = (f"w{w}", f"3{w[:3]}" if len(w) > 3 else "", f"4{w[:4]}" if len(w) > 4 else "", f"5{w[:5]}" if len(w) > 5 else "", f"e{w[-3:]}" if len(w) > 3 else "")
    return tuple(crc32(f.encode("utf-8", "surrogatepass")) & (1 << BITS) - 1 for f in named if f)


@dataclass
class Field:
    """Weights of the features for toxic over clean, log-potentials of the transitions, and the curve of the score.

    The last weight stands for no feature and is 0.
    """

    weights: np.ndarray
    bias: float = 0.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def evidence(self, word: str) -> float:
        return float(self.weights[list(features(word))].sum()) + self.bias


def marginals(evidence: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every word, and the expected transitions in all; texts are laid end to end.

    The texts advance together, longest first, so that the work a step is over an array. Only the odds of toxic over
    clean are carried along.
    """
    order = np.argsort(-lengths, kind="stable")
    lens = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    ahead, back = np.empty_like(evidence), np.empty_like(evidence)
    (s00, s01), (s10, s11) = steps
    longest = int(lens[0]) if len(lens) else 0
    alive = np.searchsorted(-lens, -np.arange(longest), side="left") if longest else []
    odds = np.zeros(len(lens))
    for t in range(longest):
        n = alive[t]
        at = starts[:n] + t
        o = odds[:n]
        if t:
            o = np.logaddexp(s01, s11 + o) - np.logaddexp(s00, s10 + o)
        odds[:n] = o = o + evidence[at]
        ahead[at] = o
    odds[:] = 0.0
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        more = alive[t + 1] if t + 1 < longest else 0
        o = np.zeros(n)
        if more:
            u = odds[:more] + evidence[at[:more] + 1]
            o[:more] = np.logaddexp(s10, s11 + u) - np.logaddexp(s00, s01 + u)
        odds[:n] = o
        back[at] = o
    p = 1.0 / (1.0 + np.exp(-np.clip(ahead + back, -40, 40)))
    last = np.cumsum(lengths) - 1
    inner = np.ones(len(evidence), bool)
    inner[last[lengths > 0]] = False
    i = np.nonzero(inner)[0]
    moves = np.zeros(4)
    for at in (i[j : j + 100_000] for j in range(0, len(i), 100_000)):  # in parts, for the driver's memory
        left, right = ahead[at], evidence[at + 1] + back[at + 1]
        cells = np.stack([np.full(len(at), s00), s01 + right, s10 + left, s11 + left + right])
        cells = np.exp(cells - cells.max(0))
        moves += (cells / cells.sum(0)).sum(1)
    return p, moves.reshape(2, 2)


def apart(texts: list[str]) -> list[int]:
    """Positions of texts none of which is a near copy of an earlier one: copies would count as evidence many times."""
    prints = np.array([fingerprint(t) for t in texts], np.uint64)
    kept: list[int] = []
    for i in range(len(texts)):
        if not kept or np.bitwise_count(prints[kept] ^ prints[i]).min() > COPY_BITS:
            kept.append(i)
    return kept


def labelled_words(flat: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, table: np.ndarray) -> np.ndarray:
    """1 for each word of a toxic text one of whose features comes from toxic texts only, too often for chance; else 0.

    table has the features of each word, flat the words of all texts by their row there.
    """
    inside, outside = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for words, y in zip(np.split(flat, np.cumsum(lengths)[:-1]), toxic, strict=True):
        (inside if y else outside)[np.unique(table[np.unique(words)])] += 1
    inside[-1] = outside[-1] = 0
    base = (inside.sum() + 1) / (inside.sum() + outside.sum() + 2)
    telling = (inside * -np.log(base) >= SURPRISE) & (inside >= LEAST_SHARE * (inside + outside))
    return np.repeat(toxic > 0, lengths) & telling[table].any(1)[flat]


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A text's figures: the chance that any word is toxic, the share of toxic words, the largest marginal, 1.

    Marginals count from FLOOR on, so that many words of little evidence do not add up in long texts.
    """
    p = np.maximum(p - FLOOR, 0) / (1 - FLOOR)
    out = np.zeros((len(lengths), 4))
    out[:, 3] = 1.0
    full = np.nonzero(lengths)[0]
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        none = np.add.reduceat(np.log1p(-np.minimum(p, 0.999999)), starts)
        out[full, 0] = np.minimum(-none, 8.0)
        out[full, 1] = np.minimum(np.add.reduceat(p, starts) / lengths[full] * 20, 2.0)
        out[full, 2] = np.maximum.reduceat(p, starts)
    return out


def fit(texts: list[str], toxic: list[int], passes: int = PASSES) -> Field:
    """The field by gradient ascent with a step size for each weight, then the curve; the same for the same sample."""
    alone = apart(texts)
    words = [texts[i].split() for i in alone]
    truly = np.array([toxic[i] for i in alone], np.float64)
    lengths = np.array([len(w) for w in words], np.int64)
    numbers: dict[str, int] = {}
    flat = np.concatenate([np.zeros(0, np.int32), *(np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), np.int32, len(ws)) for ws in words)])
    table = np.full((len(numbers), 5), 1 << BITS, np.int32)
    for w, i in numbers.items():
        told = features(w)
        table[i, : len(told)] = told
    del words, numbers
    model = Field(np.zeros((1 << BITS) + 1))
    truth = labelled_words(flat, lengths, truly, table).astype(np.float64) if len(alone) else np.zeros(0)
    if not truth.sum():
        model.bias, model.curve = -8.0, np.array([0.0, 0.0, 0.0, -4.0])
        return model
    weights, speed = model.weights, np.full((1 << BITS) + 1, 1e-3)
    small, small_speed = np.array([-4.0, 1.0, 0.0, 0.0, 1.0]), np.full(5, 1e-3)
    inner = np.ones(len(flat), bool)
    inner[(np.cumsum(lengths) - 1)[lengths > 0]] = False
    i = np.nonzero(inner)[0]
    moves = np.bincount((2 * truth[i] + truth[i + 1]).astype(int), minlength=4).astype(float)
    del i, inner
    for _ in range(passes):
        of_word = weights[table].sum(1) + small[0]
        p, expected = marginals(of_word[flat], lengths, small[1:].reshape(2, 2))
        error = np.bincount(flat, truth - p, minlength=len(table))
        slope = np.bincount(table.ravel(), np.repeat(error, table.shape[1]), minlength=len(weights)) - 0.05 * weights
        slope[-1] = 0.0
        speed += slope * slope
        weights += 0.6 * slope / np.sqrt(speed)
        slope = np.concatenate([[error.sum()], moves - expected.ravel()]) - 0.05 * small
        small_speed += slope * slope
        small += 0.3 * slope / np.sqrt(small_speed)
    model.bias, model.steps = float(small[0]), small[1:].reshape(2, 2)
    p, _ = marginals((weights[table].sum(1) + model.bias)[flat], lengths, model.steps)
    x, y, curve = summary(p, lengths), truly, np.zeros(4)
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ curve))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.02 * np.eye(4)
        curve += np.linalg.solve(hessian, x.T @ (y - q) - 0.02 * curve)
    model.curve = curve
    return model


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of words whose marginals stand out: offsets in code points, end exclusive, and the largest marginal."""
    out: list[dict] = []
    joined = False
    for i, m in enumerate(_split(text)):
        if p[i] < SPAN_AT:
            joined = False
            continue
        if joined:
            out[-1]["end"], out[-1]["p"] = m[1], max(out[-1]["p"], float(p[i]))
        else:
            out.append({"start": m[0], "end": m[1], "p": float(p[i])})
        joined = True
    return out


def _split(text: str) -> Iterator[tuple[int, int]]:
    """Offsets of the words that str.split() gives."""
    at = 0
    for word in text.split():
        at = text.index(word, at)
        yield at, at + len(word)
        at += len(word)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))


def scored_by(told: Callable, at: int, names: list[str], with_spans: bool) -> Callable:
    """The task: columns of the batch, then the score and, if wanted, the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Field = told()
        evidence = Memo(model.evidence, 400_000)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in slices(batches, at):
            texts = [t.as_py() or "" for t in batch.column(at)]
            found = [np.fromiter(map(evidence.__getitem__, t.split()), np.float64) for t in texts]
            lengths = np.array([len(x) for x in found], np.int64)
            p, _ = marginals(np.concatenate(found), lengths, model.steps)
            score = 1 / (1 + np.exp(-summary(p, lengths) @ model.curve))
            more = [pa.array(score)]
            if with_spans:
                ends = np.cumsum(lengths)
                more.append(pa.array([spans(t, p[e - n : e]) if n and p[e - n : e].max() >= SPAN_AT else [] for t, n, e in zip(texts, lengths, ends, strict=True)], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    return run


def tag(docs: DataFrame, model: Field, *, text_col: str = "text", score: str = "score", found: str | None = "spans") -> DataFrame:
    """docs with each whole text's score and, unless found is None, its toxic spans (start, end, p).

    Null and empty texts have no words: their score is that of a text without evidence, and no span. Rows that repeat
    score alike; other columns come along and are no input. score and found must be new names, see fresh(): a name that is
    there already is an error.
    """
    check_new(docs, score, found)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    more = [T.StructField(score, T.DoubleType())] + ([T.StructField(found, SPANS)] if found else [])
    schema = T.StructType([*docs.schema.fields, *more])
    return docs.mapInArrow(scored_by(lambda: sent.value, docs.columns.index(text_col), schema.names, bool(found)), schema)


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, rows: int = SAMPLE_ROWS) -> Field:
    """The field for a folder of tables: labelled rows outside the held-out fold, at most rows of them."""
    texts, toxic, _ = training_rows(read(spark, sf_dir, "documents") if docs is None else docs, read(spark, sf_dir, "labels"), "toxic", rows)
    return fit(texts, toxic)


def clean(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""
    score = fresh(docs, "score")[0]
    return tag(docs, model, text_col=text_col, score=score, found=None).where(F.col(score) < TOXIC_AT).select(*map(quoted, docs.columns))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = tag(docs, trained(spark, sf_dir))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"), offsets.alias("spans"))
