"""Quality rules: statistics of whole texts, a fixed base rule, and gradient-boosted trees for the verdict.

The trees are fitted with numpy on the driver, from the statistics of a bounded sample of labelled documents
(`most_labels`, the one bound here), by histogram splits under the logistic loss. Chosen features are monotonic: more
symbols, repeated lines, repeated windows or capitals never raise a document's score. The forest is flattened into node
arrays, and a slice of documents walks all trees level by level at once. Statistics are exact and cover whole texts.

Cases: a null or empty text has no words and fails the base rule; repeated rows are scored alike; without labels of both
kinds there is no forest and the base rule decides alone; an empty table gives an empty result; other columns are kept by
keep() and ignored elsewhere.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import labelled, slices, table

LEAST_WORDS = 50
MOST_REPEATED = 0.5
#: A document stays when the forest's probability that it is good is at least this: clean documents weigh more than junk.
KEEP_AT = 0.35
MOST_LABELS = 20_000

FEATURES = ["words", "word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "distinct", "exclamations", "bars", "digits", "line_words", "stops", "other_script"]
#: -1: the score may only fall as the feature grows.
MONOTONE = {"symbols": -1, "repeated_lines": -1, "repeated_words": -1, "capitals": -1, "exclamations": -1}

_SPACE, _SYMBOL, _UPPER, _LOWER, _DIGIT, _BANG, _BAR, _STOP, _LINE, _WIDE, _TAIL = (1 << i for i in range(11))


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for bit, members in ((_SPACE, b" \t\n\r\x0b\x0c"), (_SYMBOL, b"#*$%&|<>"), (_UPPER, bytes(range(65, 91))), (_LOWER, bytes(range(97, 123))), (_DIGIT, b"0123456789"), (_BANG, b"!"), (_BAR, b"|"), (_STOP, b".?"), (_LINE, b"\n"), (_WIDE, bytes(range(192, 256))), (_TAIL, bytes(range(128, 192)))):
        out[list(members)] |= bit
    return out


CLASSES = _classes()


class Stats(NamedTuple):
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    features: np.ndarray


def _repeated(ids: np.ndarray, doc: np.ndarray, n_docs: int, most: int) -> np.ndarray:
    """Words of each document that lie in 3-word windows found twice or more in it. ids: below most, document after document."""
    at = np.flatnonzero(doc[2:] == doc[:-2]) if len(ids) > 2 else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(n_docs, np.int64)
    if 3 * most.bit_length() <= 63:
        b = most.bit_length()
        key = (ids[at] << 2 * b) | (ids[at + 1] << b) | ids[at + 2]
    else:
        pair = np.unique(ids[at] * most + ids[at + 1], return_inverse=True)[1]
        key = pair * most + ids[at + 2]
    order = np.lexsort((key, doc[at]))
    k, d = key[order], doc[at][order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(ids) + 3, np.int64)
    begin = at[twice]
    np.add.at(covered, begin, 1)
    np.add.at(covered, begin + 3, -1)
    return np.bincount(doc[np.cumsum(covered)[: len(ids)] > 0], minlength=n_docs)


def statistics(texts: list[str | None]) -> Stats:
    """Exact statistics of whole texts and the features of the forest."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    n = len(raw)
    number: dict[bytes, int] = defaultdict(count().__next__)
    dup, lines, n_words, distinct = (np.zeros(n, np.int64) for _ in range(4))
    parts = []
    for i, t in enumerate(raw):
        found = t.split()
        ids = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        parts.append(ids)
        n_words[i], distinct[i] = len(found), len(set(found))
        full = [x for x in t.split(b"\n") if x.strip()]
        lines[i] = len(full)
        dup[i] = len(full) - len(set(full))
    repeat = _repeated(np.concatenate([*parts, np.zeros(0, np.int64)]), np.repeat(np.arange(n), n_words), n, len(number) + 1)
    # a blank after each text keeps reduceat's spans non-empty
    kinds = CLASSES[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw])[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)

    def total(bits: int) -> np.ndarray:
        return np.add.reduceat((kinds & bits) != 0, starts, dtype=np.int64) if n else np.zeros(0, np.int64)

    chars = np.array([len(t) for t in raw], np.int64) + 1 - total(_SPACE) - total(_TAIL)
    symbols, upper, lower = total(_SYMBOL), total(_UPPER), total(_LOWER)
    some, letters = np.maximum(n_words, 1), np.maximum(upper + lower, 1)
    features = np.column_stack([np.log1p(n_words), chars / some, symbols / some, dup / np.maximum(lines, 1), repeat / some, upper / letters, distinct / some, total(_BANG) / some, total(_BAR) / some, total(_DIGIT) / np.maximum(chars, 1), n_words / np.maximum(lines, 1), total(_STOP) / some, total(_WIDE) / np.maximum(chars, 1)])
    return Stats(n_words, chars, symbols, dup, repeat, features)


class Forest(NamedTuple):
    """Trees as node arrays: row t holds tree t; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            down = x[rows, self.feature[trees, at]] <= self.threshold[trees, at]
            at = np.where(down, self.left[trees, at], self.right[trees, at])
        return 1 / (1 + np.exp(-(self.base + self.value[trees, at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, names: list[str] = FEATURES, monotone: dict[str, int] = MONOTONE, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Forest:
    """Boost `trees` trees on histograms. A monotonic feature's split is taken only if its sides keep the order, and the
    sides' middle then bounds all that comes below, so the whole tree keeps it."""
    signs = [monotone.get(n, 0) for n in names]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    width = 2 ** (depth + 1) - 1
    f, th, l, r, v = np.zeros((trees, width), np.int64), np.zeros((trees, width)), *(np.tile(np.arange(width), (trees, 1)) for _ in range(2)), np.zeros((trees, width))
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        node = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                if k not in bounds:
                    continue
                rows, (lo, hi) = np.flatnonzero(node == k), bounds[k]
                whole_g, whole_h, best = g[rows].sum(), h[rows].sum(), (1e-6, None)
                for j, c in enumerate(cuts):
                    if not len(c) or len(rows) < 2 * least:
                        continue
                    b = binned[rows, j]
                    gl, hl, n = (np.cumsum(np.bincount(b, w, minlength=len(c) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-(whole_g - gl) / (whole_h - hl + ridge), lo, hi)
                    gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - ((whole_g - gl) * vr + 0.5 * (whole_h - hl + ridge) * vr**2)
                    gain -= 0.5 * whole_g**2 / (whole_h + ridge)
                    gain[(n < least) | (len(rows) - n < least) | (signs[j] * (vr - vl) < 0)] = -1
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (gain[i], (j, i, vl[i], vr[i]))
                if best[1] is None:
                    continue
                j, i, vl, vr = best[1]
                f[t, k], th[t, k], l[t, k], r[t, k] = j, cuts[j][i], 2 * k + 1, 2 * k + 2
                middle = (vl + vr) / 2
                below = {1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle)), 0: ((lo, hi), (lo, hi))}[signs[j]]
                bounds[2 * k + 1], bounds[2 * k + 2] = below
                v[t, 2 * k + 1], v[t, 2 * k + 2] = rate * vl, rate * vr
                node[rows] = np.where(binned[rows, j] <= i, 2 * k + 1, 2 * k + 2)
        margin += v[t, node]
    return Forest(f, th, l, r, v, base, depth)


def train(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> Forest | None:
    """The forest from documents with a quality label; None where labels of either kind are missing."""
    known = dict(labelled(labels, "quality", most_labels))
    if len(set(known.values())) < 2:
        return None
    spark = docs.sparkSession
    ids = spark.createDataFrame([(k,) for k in known], "doc_id long")
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = statistics(batch.column(1).to_pylist()).features
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = picked.mapInArrow(run, "doc_id long, x array<double>").dropDuplicates(["doc_id"]).collect()
    rows = sorted((r[0], r[1]) for r in rows)
    y = np.array([known[d] for d, _ in rows], np.float64)
    if len(set(y)) < 2:
        return None
    return fit(np.array([x for _, x in rows]), y)


def verdicts(s: Stats, forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, kept and the forest's score."""
    failed = (s.n_words < LEAST_WORDS) | (s.n_repeat_words > MOST_REPEATED * s.n_words)
    score = forest.score(s.features) if forest and len(s.features) else np.ones(len(s.n_words))
    return failed, ~failed & (score >= KEEP_AT), score


def report(docs: DataFrame, forest: Forest | None) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = statistics(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in s[:5]), *(pa.array(c) for c in verdicts(s, sent.value))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def keep(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of docs that stay, with all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = statistics(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(verdicts(s, sent.value)[1]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(docs, train(docs, table(spark, sf_dir, "labels")))
