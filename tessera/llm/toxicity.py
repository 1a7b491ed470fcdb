"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the words of a text and their beginnings (inflected and compound forms share them) is fitted with numpy on the driver from confirmed toxic documents and
unlabelled ones. The risk is estimated with the class prior: prior * (loss of positives as positive) + max(0, loss of
unlabelled as negative - prior * loss of positives as negative); where the second part goes below zero, its gradient is
turned round, which keeps the classifier from explaining single positives. Labels of training rows then calibrate the
margin to a probability. Labels come only from rows that are not held out; the fit takes bounded samples, which are
parameters (`most_labels`, `most_unlabelled`, `most_words`). Scoring covers whole texts of all rows.

Cases: a null or empty text has no words and gets the intercept's probability; repeated rows are scored alike; without
confirmed toxic rows every score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, labelled, slices, stored, table
from tessera.llm.decontam import words

THRESHOLD = 0.3
MOST_LABELS = 16_000
MOST_UNLABELLED = 16_000
MOST_WORDS = 4096
#: A word must be in so many confirmed documents to be a feature.
LEAST_DOCS = 3


#: Lengths in bytes of a word's beginnings; how many different words with one beginning make a feature of their own.
BEGINNINGS = (5, 6, 7, 8)
LEVELS = (1, 2, 3, 5)


def features(text: str | None) -> list[bytes]:
    """Distinct features: "=word", "n^beginning" where at least n different words begin so, "#k" for 2^k words or more."""
    found = set(words(text))
    begun = Counter(w[:n] for w in found for n in BEGINNINGS if len(w) > n)
    out = [b"=" + w for w in found]
    out += [b"%d^%s" % (n, b) for b, k in begun.items() for n in LEVELS if k >= n]
    out += [b"#%d" % k for k in range(len(found).bit_length())]
    return out


class Model(NamedTuple):
    weights: dict[bytes, float]
    intercept: float
    slope: float  # calibration: probability = sigmoid(slope * margin + shift)
    shift: float
    starts: frozenset  # the first five bytes of every word that a weighted feature can concern

    def score(self, text: str | None) -> float:
        """As over features(text), but only features with a weight are built."""
        get, starts = self.weights.get, self.starts
        found = set(words(text))
        margin = self.intercept + sum(get(b"#%d" % k, 0.0) for k in range(len(found).bit_length()))
        begun: dict[bytes, int] = {}
        for w in found:
            if w[:5] in starts:
                margin += get(b"=" + w, 0.0)
                for n in BEGINNINGS:
                    if len(w) > n:
                        begun[w[:n]] = begun.get(w[:n], 0) + 1
        for b, k in begun.items():
            for n in LEVELS:
                if k >= n:
                    margin += get(b"%d^%s" % (n, b), 0.0)
        return float(_sigmoid(self.slope * margin + self.shift))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Documents as lists of feature numbers, with products against weights and their transpose."""

    def __init__(self, lists: list[list[int]], width: int):
        self.n, self.width = len(lists), width
        self.row = np.repeat(np.arange(self.n), [len(x) for x in lists])
        self.column = np.array([j for x in lists for j in x], np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, g[self.row], minlength=self.width)


def nnpu(positive: Rows, unlabelled: Rows, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 1e-4, beta: float = 0.0, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept that lessen the non-negative risk under the logistic loss, by Adam over full batches."""
    w = np.zeros(positive.width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        zp, zu = positive.times(w[:-1]) + w[-1], unlabelled.times(w[:-1]) + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_positive = -prior * _sigmoid(-zp) / positive.n
        u, p = _sigmoid(zu) / unlabelled.n, -prior * _sigmoid(zp) / positive.n
        gp, gu = (as_positive + p, u) if negative >= -beta else (-gamma * p, -gamma * u)
        g = np.append(positive.back(gp) + unlabelled.back(gu), gp.sum() + gu.sum())
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """slope and shift of a logistic curve through (margin, label), by Newton steps; the slope stays positive."""
    scale = max(z.std(), 1e-6)
    x, target = np.column_stack([z / scale, np.ones_like(z)]), np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(x @ a)
        h = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x.T * h) @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * a)
        a = a - np.clip(step, -2, 2)
    return float(max(a[0], 1e-3) / scale), float(a[1])


def train(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, most_unlabelled: int = MOST_UNLABELLED, most_words: int = MOST_WORDS) -> Model | None:
    """The classifier; None without confirmed toxic documents outside the held-out rows."""
    spark = docs.sparkSession
    known = dict(labelled(labels, "toxic", most_labels))
    if not any(known.values()):
        return None
    ids = spark.createDataFrame(list(known.items()), "doc_id long, label int")
    n = max(docs.count(), 1)
    sampled = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(n)) < most_unlabelled
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").withColumn("unlabelled", F.coalesce(sampled & ~held_out(), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary())), batch.column(2), batch.column(3)], names=["doc_id", "words", "label", "unlabelled"])

    # a repeated id counts once, so that neither sample outgrows its bound
    sample = stored(rows.filter("label is not null or unlabelled").mapInArrow(run, "doc_id long, words array<binary>, label int, unlabelled boolean").dropDuplicates(["doc_id"]), "toxicity-sample")
    n_p, n_u = (int(x or 0) for x in sample.agg(F.sum((F.col("label") == 1).cast("int")), F.sum(F.col("unlabelled").cast("int"))).first())
    if not n_p or not n_u:
        return None
    counted = sample.select(F.explode("words").alias("w"), (F.col("label") == 1).cast("int").alias("p"), F.col("unlabelled").cast("int").alias("u")).groupBy("w").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.sum("u").alias("u"))
    share = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 1)
    gap = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share) + 1e-9)
    vocabulary = [bytes(r[0]) for r in counted.filter(F.col("p") >= LEAST_DOCS).orderBy(gap.desc(), "w").limit(most_words).collect()]
    number = {w: i for i, w in enumerate(vocabulary)}
    lookup = spark.sparkContext.broadcast(number)

    def known_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = lookup.value
        for batch in batches:
            found = [[get[w] for w in x if w in get] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2), batch.column(3)], names=["doc_id", "features", "label", "unlabelled"])

    held = sorted((tuple(r) for r in sample.mapInArrow(known_words, "doc_id long, features array<int>, label int, unlabelled boolean").collect()), key=lambda r: r[0])
    lists = lambda keep: Rows([r[1] for r in held if keep(r)], len(number))
    told = [r for r in held if r[2] is not None]
    prior = float(np.clip(np.mean([r[2] for r in told]), 0.01, 0.9))
    w, b = nnpu(lists(lambda r: r[2] == 1), lists(lambda r: r[3]), prior)
    z = lists(lambda r: r[2] is not None).times(w) + b
    slope, shift = calibrate(z, np.array([r[2] for r in told], np.float64))
    starts = frozenset(f.partition(f[:1] if f[:1] == b"=" else b"^")[2][:5] for f in number if f[:1] != b"#")
    return Model({x: float(w[i]) for x, i in number.items()}, b, slope, shift, starts)


def report(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in slices(batches):
            scores = [held.score(t) if held else 0.0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(docs, train(docs, table(spark, sf_dir, "labels")))
