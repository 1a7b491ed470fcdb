"""Near duplicates by order min-hash, verified by banded alignment.

A text is its words (lower case, letters and digits). Every run of K words is a k-mer, labelled with how often it has
occurred before in the text. Each of SKETCHES seeds picks the TAKE k-mers with the least hashes and keeps them in text
order: two texts agree on a sketch when they share those k-mers in the same order, which favours texts that are close by
edit distance. Texts that share a sketch are candidates, and a pair is a link when a banded alignment of its words needs
at most a fifth of the longer text's length in edits (similarity 0.8 or more). Classes are the connected components.

K is three words: with an edit in every fifth word two runs in five are still shared, while of runs of five words none would
be. Texts of up to ALL words have all their runs as keys besides, since a link among them leaves at least one (of two
words where there are five at most), so no link among them is missed; those of up to MIDDLE words have all sketches,
longer ones, whose k-mers are many, the first SKETCHES of them.

Equal word sequences fold into one node first. In each bucket all nodes are compared with the bucket's centre (within
a task's rows beforehand, so that a hot bucket sends few rows), which connects most groups. Then every pair that shares a
key and is not connected is tested, a few of each node before all: buckets that still hold several classes are, beyond BLOCK nodes, cut by length
(a link's lengths differ by a fifth at most) and into blocks, and a task tests the pairs of two blocks against a bound on the edits from bags of
words. Only what the bound leaves becomes rows, once for each pair, and is aligned. No bucket is capped. Joins deal the rows of hot keys (a
bucket's least node, a large class, a group of copies) over several tasks.

Cases: null, empty and blank texts are one class of copies; other texts without words are copies where they are equal;
texts of fewer than four words have copies alone; a repeated row is a copy; rows with one doc_id and different texts each
keep their class; an empty table gives an empty result; other columns are kept by representatives() and ignored elsewhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import attached, counted, slices, spread_join, stored, table
from tessera.llm.decontam import words as ascii_words

K = 3
#: Sketches of texts of more and of at most MIDDLE words.
SKETCHES, MORE, MIDDLE = 32, 64, 64
TAKE = 2
#: A link needs edits * EDITS_IN <= words of the longer text: similarity 0.8.
EDITS_IN = 5
#: Alignments of at most so many edits go by diagonals.
NEAR = 24
#: Texts of at most ALL words have all their runs as keys.
ALL = 24
#: Counters in the bag of words that bounds the edits of a pair: about one a word, in powers of two, between these.
LEAST_BAG, MOST_BAG = 64, 2048
#: About how many nodes of a bucket meet as many others in a task.
BLOCK = 1024
#: About how many pairs of each node of a bucket are tested before all others.
FEW = 16.0

_ODD = np.random.default_rng(11).integers(1, 2**31, (MORE, 2)).astype(np.uint32) | np.uint32(1)


def words(text: str | None) -> list[bytes]:
    return ascii_words(text.lower()) if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(w: np.ndarray, sizes: np.ndarray, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of the marked texts, and how many each of these has. w: the words' hashes, text by text."""
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(w))
    begin = np.flatnonzero((left >= k) & np.repeat(rows, sizes))
    x = np.full(len(begin), k, np.uint64)
    for j in range(k):
        x = _mix(x + w[begin + j] * np.uint64(2 * j + 3))
    return x, np.maximum(sizes[rows] - k + 1, 0)


def _labelled(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The r-th equal k-mer of a text gets a hash of its own."""
    y = _mix(x + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(y, kind="stable")
    new = np.concatenate([[True], y[order][1:] != y[order][:-1]])
    if new.all():
        return x
    at = np.arange(len(x))
    r = np.zeros(len(x), np.uint64)
    r[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(r > 0, _mix(x + r * np.uint64(0x9E3779B97F4A7C15)), x)


def sketches(w: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each text its order sketches (int64). w: the words' hashes, text by text."""
    rows = sizes >= K
    out = [np.zeros(0, np.int64)] * len(sizes)
    if not rows.any():
        return out
    x, kmers = _runs(w, sizes, K, rows)
    starts = np.cumsum(kmers) - kmers
    x = _labelled(x, np.repeat(np.arange(len(kmers)), kmers))
    at = (np.arange(len(x)) - np.repeat(starts, kmers)).astype(np.uint64)
    low = (x >> np.uint64(32)).astype(np.uint32)
    short = sizes[rows] <= MIDDLE
    made = np.zeros((len(kmers), MORE), np.int64)
    mine = np.arange(len(kmers))
    for s, (odd, flip) in enumerate(_ODD):
        if s == SKETCHES:  # from here on for the shorter texts alone
            keep = np.repeat(short, kmers)
            x, at, low, mine, kmers = x[keep], at[keep], low[keep], mine[short], kmers[short]
            starts = np.cumsum(kmers) - kmers
        if not len(kmers):
            break
        h = (low ^ flip) * odd
        h ^= h >> np.uint32(16)
        h *= odd
        # the place in the low half: a minimum tells both what and where
        v = (h.astype(np.uint64) << np.uint64(32)) | at
        picked = []
        for _ in range(TAKE):
            least = np.minimum.reduceat(v, starts)
            none = least == np.uint64(2**64 - 1)
            place = np.where(none, -1, (least & np.uint64(0xFFFFFFFF)).astype(np.int64))
            picked.append(place)
            v[(starts + place)[~none]] = np.uint64(2**64 - 1)
        key = np.full(len(kmers), s + 1, np.uint64)
        for place in np.sort(np.column_stack(picked), axis=1).T:
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.where(place >= 0, x[starts + np.maximum(place, 0)], np.uint64(s)))
        made[mine, s] = key.view(np.int64)
    for i, row, few in zip(np.flatnonzero(rows).tolist(), made, short.tolist(), strict=True):
        out[i] = row if few else row[:SKETCHES]
    return out


def keys(w: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each text its keys: the sketches, and all runs of a short one (of two words where there are five at most)."""
    out = sketches(w, sizes)
    for k, rows in ((K, (sizes > EDITS_IN) & (sizes <= ALL)), (2, (sizes >= EDITS_IN - 1) & (sizes <= EDITS_IN + 1))):
        x, n = _runs(w, sizes, k, rows)
        ends = np.cumsum(n)
        for i, lo, hi in zip(np.flatnonzero(rows).tolist(), (ends - n).tolist(), ends.tolist(), strict=True):
            out[i] = np.concatenate([out[i], np.unique(x[lo:hi]).view(np.int64)])
    return out


def bags(w: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each text capped counts of its hashed words in a power of two of cells."""
    cells = np.clip(1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), LEAST_BAG, MOST_BAG)
    ends = np.cumsum(cells)
    cell = np.repeat(ends - cells, sizes) + (w % np.repeat(cells, sizes).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(cell, minlength=int(ends[-1]) if len(ends) else 0), 255).astype(np.uint8)
    return [counts[lo:hi].tobytes() for lo, hi in zip((ends - cells).tolist(), ends.tolist(), strict=True)]


def bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """The sum of differences of two bags, the longer folded to the shorter's cells."""
    n = min(len(a), len(b))
    a, b = (v.reshape(-1, n).sum(axis=0, dtype=np.int32) if len(v) > n else v.astype(np.int32) for v in (a, b))
    return int(np.abs(a - b).sum())


def _columns(p: list[int], q: list[int], most: int) -> int | None:
    """edits() column by column: a column of the alignment is two bit vectors of its steps (Myers, 1999), here whole integers."""
    n, m = len(p), len(q)
    places: dict[int, int] = {}
    for i, w in enumerate(p):
        places[w] = places.get(w, 0) | 1 << i
    whole, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score, get = whole, 0, n, places.get
    for j, w in enumerate(q):
        eq = get(w, 0)
        d = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(d | up) & whole, d & up
        score += bool(right & last) - bool(left & last)
        if score - (m - j - 1) > most:
            return None  # each column left lessens it by one at most
        right = (right << 1 | 1) & whole
        up, down = (left << 1 | ~(d | right)) & whole, right & d
    return score if score <= most else None


def edits(a: list, b: list, most: int) -> int | None:
    """Word edits from a to b if at most `most`, else None: the furthest reach of each diagonal of the band, edit by edit; where
    NEAR edits do not do, column by column."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    ids: dict = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in a], np.int64)
    y = np.array([ids.setdefault(w, len(ids)) for w in b], np.int64)
    p, q = x.tolist(), y.tolist()

    def slide(i: int, j: int) -> int:
        """The end in a of the equal words from a[i], b[j]."""
        for _ in range(6):
            if i >= n or j >= m or p[i] != q[j]:
                return i
            i, j = i + 1, j + 1
        width = 64
        while True:
            k = min(width, n - i, m - j)
            if k <= 0:
                return i
            differ = x[i : i + k] != y[j : j + k]
            at = int(differ.argmax())
            if differ[at]:
                return i + at
            i, j, width = i + k, j + k, 4 * width

    goal = m - n
    reach = {0: slide(0, 0)}
    if goal == 0 and reach[0] == n:
        return 0
    for d in range(1, most + 1):
        if d > NEAR:
            return _columns(p, q, most)
        new = {}
        # a diagonal from which the rest of the edits cannot lead to the goal is not followed
        for k in range(max(-d, goal - (most - d)), min(d, goal + (most - d)) + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -1), reach.get(k + 1, -2) + 1)
            if i < 0 or i > n or i + k > m or i + k < 0:
                continue
            new[k] = slide(i, i + k)
        if new.get(goal) == n:
            return d
        reach = new
    return None


def linked(a: list, b: list) -> bool:
    """Whether the alignment of two word lists has similarity 0.8 or more. Words in common bound it before any alignment."""
    longest = max(len(a), len(b))
    most = longest // EDITS_IN
    if not longest:
        return False  # marks alone are no words to align
    if abs(len(a) - len(b)) > most or longest - sum((Counter(a) & Counter(b)).values()) > most:
        return False
    return edits(a, b, most) is not None


def _digest(found: list[bytes], text: str | None) -> bytes:
    """Equal for equal word sequences; texts without words (but for blanks) are told apart as they are."""
    return xxhash.xxh3_128_digest(b" ".join(found) if found else b"\0" + (text or "").strip().encode("utf-8", "surrogatepass"))


def nodes(docs: DataFrame) -> DataFrame:
    """row (a number), doc (the whole row), digest (of its words), keys, bag and size (in words) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            known = _Hashes()
            texts = batch.column(0).to_pylist()
            found = [words(t) for t in texts]
            sizes = np.array([len(x) for x in found], np.int64)
            w = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.uint64, sizes.sum())
            own = keys(w, sizes)
            ends = np.cumsum([0, *map(len, own)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(len(found))),
                    batch.column(1),
                    pa.array([_digest(x, t) for x, t in zip(found, texts, strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*own, np.zeros(0, np.int64)]))),
                    pa.array(bags(w, sizes), pa.binary()),
                    pa.array(sizes, pa.int32()),
                ],
                names=["row", "doc", "digest", "keys", "bag", "size"],
            )
            row += len(found)

    fields = [("row", T.LongType()), ("doc", docs.schema), ("digest", T.BinaryType()), ("keys", T.ArrayType(T.LongType())), ("bag", T.BinaryType()), ("size", T.IntegerType())]
    made = docs.select("text", F.struct(*docs.columns).alias("doc")).mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))
    return stored(made, "neardup-nodes")


def _stars(distinct: DataFrame) -> DataFrame:
    """key, node, rep: each node of a bucket with the bucket's centre, in two steps: first the centre of the batch's nodes, and for these
    the centre of all. The centre is the node that comes first by a hash with the key, so that a group's buckets have different ones."""

    def star(heads: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(1)
                key = own.flatten().to_numpy(zero_copy_only=False)
                node = np.repeat(batch.column(0).to_numpy(), np.diff(own.offsets.to_numpy()))
                rank = _mix(node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key.view(np.uint64)).view(np.int64)
                order = np.lexsort((rank, key))
                key, node, rank = key[order], node[order], rank[order]
                first = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
                if heads:
                    yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(node[first]), pa.array(rank[first])], names=["key", "node", "rank"])
                else:
                    rep = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] if len(key) else node
                    keep = ~first & (node != rep)
                    yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep]), pa.array(rep[keep])], names=["key", "node", "rep"])

        return run

    centre = F.first("node").over(Window.partitionBy("key").orderBy("rank", "node"))
    heads = distinct.mapInArrow(star(True), "key long, node long, rank long").withColumn("rep", centre).filter("node <> rep")
    return stored(heads.select("key", "node", "rep").unionAll(distinct.mapInArrow(star(False), "key long, node long, rep long")), "neardup-stars")


def _verified(pairs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The pairs (stored: node, rep, mine, other; n at most) that are links. Texts go to the pairs' tasks; a node's text goes to several tasks where many pairs have it as rep."""
    parts = F.ceil(F.col("_n") / BLOCK).cast("int").alias("_of")
    reps, _ = counted(pairs.groupBy("rep").agg(F.count(F.lit(1)).alias("_n")).select("rep", parts), "neardup-pairs", n)
    dealt = spread_join(pairs, reps, ["rep"], rows=n).withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_of")).cast("int")).drop("_of")
    texts = rows.select("row", F.col("doc.text").alias("text"))
    left = attached(texts.toDF("node", "a"), dealt, "node", n)
    right = attached(texts.toDF("rep", "b"), reps.select("rep", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_part")), "rep", n)
    both = left.join(right.hint("merge"), ["rep", "_part"]).select("rep", "mine", "other", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, [])
        for batch in batches:
            keep = []
            for rep, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if held[0] != rep:
                    held = (rep, words(b))
                keep.append(linked(words(a), held[1]))
            yield pa.RecordBatch.from_arrays(batch.columns[1:3], names=["mine", "other"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "mine long, other long")


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node, label for the nodes of links (node, rep; `rows` at most): label is the least node that is connected to it.

    Alternating large-star and small-star steps (Kiveris et al., 2014): neighbourhoods are folded into their least node
    by grouped minima and joins that deal large neighbourhoods over several tasks, so none meets in one. Before each step
    every task replaces the edges it reads by stars over the same nodes, which shortens chains.
    """

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                parent[max(a, b)] = min(a, b)
        ends = [(x, r) for x in parent if (r := root(x)) != x]
        for k in range(0, len(ends), 100_000):
            u, v = zip(*ends[k : k + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    edges = stored(links.select(F.greatest("node", "rep").alias("u"), F.least("node", "rep").alias("v")).filter("u <> v").distinct(), "neardup-edges", rows)
    while True:
        edges = stored(edges.mapInArrow(forest, "u long, v long"), "neardup-forest")
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        twice = rows and 2 * rows
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(spread_join(both, least, ["u"], rows=twice).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "neardup-large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "neardup-low", twice)
        small = spread_join(large, low, ["u"], rows=twice).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, n = counted(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "neardup-star", twice)
        # a forest of stars: no node has two centres, and no centre has one of its own
        ends = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        centres = edges.select(F.col("v").alias("u")).distinct()
        if ends.count() == n and centres.join(ends, "u", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(centres.select(F.col("u").alias("node"), F.col("u").alias("label")))


def _across(pairs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """node, rep, mine, other (the classes, the lesser first): the pairs (stored: node, rep and others) whose nodes are not connected yet.
    rows: a bound of labels' rows."""
    told = stored(spread_join(pairs, labels.withColumnRenamed("label", "_mine"), ["node"], rows=rows), "neardup-told")
    both = spread_join(told, labels.select(F.col("node").alias("rep"), F.col("label").alias("_other")), ["rep"], rows=rows).filter("_mine <> _other")
    return both.withColumn("mine", F.least("_mine", "_other")).withColumn("other", F.greatest("_mine", "_other")).drop("_mine", "_other")


def _bounded(t: pa.Table, low: float, high: float) -> Iterator[pa.RecordBatch]:
    """The pairs of nodes within the cells of t (sorted by cell and size) that are not connected, may be links, and lie in the slice of hashes."""
    cell, size, label, upper, salt, alone, nodes = (t[c].to_numpy() for c in ("cell", "size", "label", "upper", "salt", "alone", "n"))
    node, n = t["node"].to_numpy(), size.astype(np.int64)
    bag = [np.frombuffer(b, np.uint8) for b in t["bag"].to_pylist()]
    at_key = t["key"].to_numpy()
    values, ends = t["keys"].combine_chunks(), None
    ends = values.offsets.to_numpy()
    flat = values.flatten().to_numpy()
    own = [flat[lo - ends[0] : hi - ends[0]] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    folded = np.stack([b.reshape(-1, LEAST_BAG).sum(axis=0, dtype=np.int32) for b in bag])
    group = np.cumsum(np.concatenate([[0], cell[1:] != cell[:-1]])) << 32
    # the longer of a link has five quarters of the shorter's words at most
    width = np.searchsorted(group + n, group + n * EDITS_IN // (EDITS_IN - 1), side="right") - np.arange(1, len(n) + 1)
    total = np.concatenate([[0], np.cumsum(width)])
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 16), side="right")) - 1)
        i = np.repeat(np.arange(at, to), width[at:to])
        j = i + 1 + np.arange(len(i)) - (total[i] - total[at])
        keep = (label[i] != label[j]) & ~(upper[i] & upper[j]) & (alone[i] | (salt[i] != salt[j]))
        i, j = i[keep], j[keep]
        # a hash that both orders of a pair share, from 0 to 1, times the cell's nodes
        place = (_mix(np.maximum(node[i], node[j]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.minimum(node[i], node[j]).view(np.uint64)) >> np.uint64(11)) * 2.0**-53 * nodes[i]
        keep = (place >= low) & (place < high)
        i, j = i[keep], j[keep]
        apart = np.abs(folded[i] - folded[j]).sum(axis=1, dtype=np.int64)
        # words not in common are edits: of the longer text, size less what both have
        most = lambda j: n[j] // EDITS_IN * 2
        keep = 2 * n[j] - (n[i] + n[j] - apart) <= most(j)
        i, j = i[keep], j[keep]
        apart = np.fromiter((bag_distance(bag[a], bag[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)), np.int64, len(i))
        keep = 2 * n[j] - (n[i] + n[j] - apart) <= most(j)
        # a pair with several keys in common is left to the least of them
        keep &= np.fromiter((np.intersect1d(own[a], own[b], assume_unique=True)[0] == at_key[a] if k else False for a, b, k in zip(i.tolist(), j.tolist(), keep.tolist(), strict=True)), bool, len(i))
        i, j = i[keep], j[keep]
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i], node[j])), pa.array(np.minimum(node[i], node[j])), pa.array(apart[keep])], names=["node", "rep", "apart"])
        at = to


def _buckets(slim: DataFrame, n_ends: int) -> DataFrame:
    """key, n, bands: the buckets of slim (key, node, label, band) that hold several classes, with their nodes and, for each band of lengths,
    its nodes, least and greatest class."""
    bands = slim.groupBy("key", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"))
    several = (F.min("lo") != F.max("hi")).alias("several")
    made = bands.groupBy("key").agg(F.sum("n").alias("n"), several, F.collect_list(F.struct("band", "lo", "hi", "n")).alias("bands"))
    return stored(made.filter("several").drop("several"), "neardup-buckets", n_ends)


def _cells(nodes: DataFrame) -> DataFrame:
    """key, node, at, upper, n, parts: nodes (key, node, label, band, and the bucket's n and bands) in cells of n nodes, to be cut into parts.

    A bucket of at most BLOCK nodes is one cell. A larger one has a cell for each band, which also holds the next band's nodes as `upper`. Nodes
    that meet none of another class are left out."""
    other = lambda x: (x["lo"] != F.col("label")) | (x["hi"] != F.col("label"))
    meets = lambda lo, hi: F.exists("bands", lambda x: x["band"].between(F.col("band") + lo, F.col("band") + hi) & other(x))
    held = lambda lo: F.aggregate("bands", F.lit(0).cast("long"), lambda n, x: n + F.when(x["band"].between(F.col("band") + lo, F.col("band") + lo + 1), x["n"]).otherwise(0))
    place = lambda at, upper, n, met: F.struct(at.cast("int").alias("at"), F.lit(upper).alias("upper"), n.alias("n"), met.alias("met"))
    whole = F.array(place(F.lit(0), False, F.col("n"), meets(-1, 1)))
    banded = F.array(place(F.col("band"), False, held(0), meets(0, 1)), place(F.col("band") - 1, True, held(-1), meets(-1, -1)))
    places = nodes.select("key", "node", F.explode(F.when(F.col("n") > BLOCK, banded).otherwise(whole)).alias("p")).select("key", "node", "p.*")
    return places.filter("met").drop("met").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))


def _untested(ends: DataFrame, known: DataFrame, labels: DataFrame, n_ends: int, low: float, high: float) -> tuple[DataFrame, int]:
    """node, rep, apart: pairs that share a key, are not connected and may be links; and the nodes of the largest cell that still holds several
    classes. ends: key, node (n_ends rows). Of the pairs of a cell of n nodes those count whose hash lies from low / n to high / n."""
    # lengths of a link lie in one band or in two that are neighbours
    band = F.floor(F.log(1.26, F.col("size").cast("double"))).cast("int")
    told = known.join(labels, "node")
    told = stored(told.withColumn("band", band), "neardup-known")
    slim = stored(spread_join(ends, told.select("node", "label", "band"), ["node"], rows=n_ends), "neardup-slim")
    buckets = _buckets(slim, n_ends)
    most = int(buckets.agg(F.max("n")).first()[0] or 0)
    if not most:
        return ends.select("node", F.col("node").alias("rep"), F.lit(0).cast("long").alias("apart")).limit(0), 0
    dealt = _cells(spread_join(slim, buckets, ["key"], rows=n_ends)).withColumn("salt", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    blocks = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select("key", "node", "upper", "salt", "n", (F.col("salt") == F.col("with")).alias("alone"), F.xxhash64("key", "at", F.least("salt", "with"), F.greatest("salt", "with")).alias("cell"))
    full = blocks.join(told.hint("merge"), "node").select("cell", "key", "size", "label", "upper", "salt", "alone", "n", "node", "bag", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                t = pa.concat_tables([held, t]) if held is not None else t
                cell = t["cell"].to_numpy()
                last = int(np.searchsorted(cell, cell[-1]))
                held = t.slice(last)
                if last:
                    yield from _bounded(t.slice(0, last), low, high)
        if held is not None:
            yield from _bounded(held, low, high)

    pairs = full.repartition("cell").sortWithinPartitions("cell", "size").mapInArrow(run, "node long, rep long, apart long")
    return pairs, most


def classes(rows: DataFrame) -> DataFrame:
    """rows: as of nodes(). digest, label: the class of every word sequence, named by a row of it."""
    reps, n_reps = counted(rows.groupBy("digest").agg(F.min("row").alias("row")), "neardup-reps")
    distinct = attached(rows.drop("doc", "digest"), reps.select("row"), "row", n_reps)
    stars = _stars(distinct.select("row", "keys"))
    n_stars = stars.count()
    votes, n_votes = counted(stars.groupBy("node", "rep").agg(F.count(F.lit(1)).alias("votes")), "neardup-votes", n_stars)
    met = votes.select("node").unionAll(votes.select("rep")).distinct()
    labels, n_met = counted(met.select("node", F.col("node").alias("label")), "neardup-labels", n_reps)

    def connect(pairs: DataFrame, n_pairs: int) -> None:
        """Test pairs (stored) and join the classes that they link."""
        nonlocal labels
        found, n = counted(_verified(pairs, rows, n_pairs), "neardup-links")
        if n:
            new = components(found.select(F.col("mine").alias("node"), F.col("other").alias("rep")), n).select(F.col("node").alias("label"), F.col("label").alias("_label"))
            labels = stored(spread_join(labels, new, ["label"], "left", ["node"], 2 * n).select("node", F.coalesce("_label", "label").alias("label")), "neardup-labels", n_met)

    # most nodes need one alignment: with the centre that they meet most often
    best = stored(votes.groupBy("node").agg(F.max_by("rep", F.struct("votes", "rep")).alias("rep")), "neardup-best", n_met)
    connect(stored(best.select("node", "rep", F.col("node").alias("mine"), F.col("rep").alias("other")), "neardup-first", n_met), n_met)
    # of two classes the pair that meets most often: what it connects needs no other
    others = stored(votes.join(best, ["node", "rep"], "left_anti"), "neardup-others", n_votes)
    nearest = _across(others, labels, n_met).groupBy("mine", "other").agg(F.max_by(F.struct("node", "rep"), F.struct("votes", "node", "rep")).alias("p")).select("p.*", "mine", "other")
    connect(*counted(nearest, "neardup-nearest", n_votes))
    # then all pairs of each bucket that holds several classes: a bucket whose stars are all connected holds one
    apart = _across(votes.select("node", "rep"), labels, n_met).select("node", "rep")
    open_keys = spread_join(stars, apart, ["node", "rep"], rows=n_votes).select("key").distinct()
    ends = stored(spread_join(stars, open_keys, ["key"], rows=n_stars), "neardup-ends")
    ends, n_ends = counted(ends.select("key", "node").unionAll(ends.select("key", F.col("rep").alias("node"))).distinct(), "neardup-members", 2 * n_stars)
    known = stored(attached(distinct.select(F.col("row").alias("node"), "size", "bag", F.array_distinct("keys").alias("keys")), ends.select("node").distinct(), "node", n_met), "neardup-bags")
    # a few pairs of each node first: where many are links, they connect most
    for low, high in ((0.0, FEW), (FEW, np.inf)):
        found, most = _untested(ends, known, labels, n_ends, low, high)
        if not most:
            break
        found, n = counted(found, "neardup-untested")
        if n:
            connect(stored(_across(found, labels, n_met).select("node", "rep", "mine", "other"), "neardup-across", n), n)
        if most <= FEW:
            break
    return reps.join(labels.withColumnRenamed("node", "row"), "row", "left").select("digest", F.coalesce("label", "row").alias("label"))


def _named(rows: DataFrame) -> DataFrame:
    """row, doc_id, label of every row."""
    slim = rows.select("row", F.col("doc.doc_id").alias("doc_id"), "digest")
    return stored(spread_join(slim, classes(rows), ["digest"], spread=["row"]).select("row", "doc_id", "label"), "neardup-named")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size for every row of docs."""
    named = _named(nodes(docs.select("doc_id", "text")))
    sized = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return spread_join(named, sized, ["label"], spread=["row"]).select("doc_id", "class_id", "class_size")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs of each class, that with the least doc_id (null ids last), with all columns."""
    rows = nodes(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    return attached(rows.select("row", "doc"), _named(rows).groupBy("label").agg(least).select("least.row"), "row").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
