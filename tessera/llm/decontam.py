"""Benchmark decontamination with suffix arrays over the training texts.

Each shard (a run of whole documents) gets a suffix array over its words: every position of every stretch of known
words that is long enough to hold a match, in the order of the whole suffixes that begin there (a sort by the first
WINDOW words, then prefix doubling among those that tie). Every suffix of every benchmark item is looked up in it by
binary search, over its first WINDOW words (an item of fewer words: all of them); the array's range is every place
where that suffix matches verbatim. What matches is extended to its longest match: the item suffixes that begin alike
lie in suffix order too, so a binary search among them finds the one that goes on the longest, without looking at all
pairs. Words that no item has are one symbol that matches nothing.

The documents are neither shuffled nor joined, and one pass does it for any number of blocks: the benchmark is a stated
query set, cut into blocks of at most `block_bytes` of text. The driver builds and broadcasts one block at a time; a task
looks a shard up in one block after the other and holds a single block, whatever the benchmark's size.

Cases: a null or empty text has no words, hits nothing and is not contaminated; an item without words has no window;
repeated rows of documents give equal rows; items with one item_id count as one item; an item whose id is null counts as
one item and adds no name to the digest; ids may be of any type; an empty benchmark leaves every document clean; ties for
the longest match go to the first place in the text; other columns are ignored by report() and matches() and kept by
clean().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import slices, table

WINDOW = 13
#: A document is contaminated when one word in SHARE is hit.
SHARE = 20
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
#: Words that are compared at once where matches are extended.
STRIDE = 16

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """UTF-8 words; bytes.lower() changes A-Z alone."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


@dataclass
class Queries:
    """A block of the benchmark: its vocabulary and the distinct windows of its suffixes, with their places."""

    vocabulary: dict[bytes, int]
    item_ids: list
    texts: np.ndarray  # all items' word ids, a 0 after each
    starts: np.ndarray  # of each item in texts
    lengths: np.ndarray  # words of each distinct window
    low: np.ndarray  # its search keys: the least and the greatest sequence that begins with it
    high: np.ndarray
    places: np.ndarray  # positions in texts, grouped by window, in suffix order within each
    first: np.ndarray  # of each window's group in places
    least: int


def _keys(sequences: np.ndarray) -> np.ndarray:
    """Rows of word ids as byte strings in the same order."""
    return np.ascontiguousarray(sequences.astype(">u4")).view(f"S{4 * WINDOW}").ravel()


def _ahead(ids: np.ndarray) -> np.ndarray:
    """How many known words begin at each position."""
    ends = np.flatnonzero(ids == 0)
    return ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids))


def _rows(ids: np.ndarray, at: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The WINDOW ids from each position, zeros after its run."""
    columns = np.arange(WINDOW)
    return np.where(columns < run[:, None], ids[np.minimum(at[:, None] + columns, len(ids) - 1)], 0)


def suffix_array(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in all stretches of at least `least` nonzero ids, in the order of the suffixes that run from them to the stretch's end, and
    the keys of their first WINDOW ids."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, f"S{4 * WINDOW}")
    run = _ahead(ids)
    begins = np.flatnonzero((ids != 0) & (np.concatenate([[0], ids[:-1]]) == 0))
    long = begins[run[begins] >= least]
    sizes = run[long]
    at = np.repeat(long - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    keys = _keys(_rows(ids, at, run[at]))
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(at)]
    rank = np.zeros(len(ids) + 1, np.int64)  # 0 where the stretch has ended
    rank[at] = np.maximum.accumulate(np.where(new, np.arange(1, len(at) + 1), 0))
    depth = WINDOW
    while True:
        # among ties, what begins `depth` words on decides; where both have ended there, the suffixes are equal
        group = np.flatnonzero(~new | np.concatenate([~new[1:], [False]])[: len(at)])
        if not len(group):
            break
        place = at[group]
        rest = np.where(run[place] > depth, rank[np.minimum(place + depth, len(ids))], 0)
        if not rest.any():
            break
        tied = rank[place]
        order = np.lexsort((rest, tied))
        at[group] = place[order]
        tied, rest = tied[order], rest[order]
        apart = np.concatenate([[True], (tied[1:] != tied[:-1]) | (rest[1:] != rest[:-1])])
        new[group] = apart
        rank[at[group]] = np.maximum.accumulate(np.where(apart, group + 1, 0))
        depth *= 2
    return at, keys


def prepare(items: list[tuple]) -> Queries:
    """items: (item_id, text)."""
    vocabulary: dict[bytes, int] = {}
    ids, starts, begin, size, item_ids = [], [], [], [], []
    for item_id, text in items:
        found = words(text)
        if not found:
            continue
        item_ids.append(item_id)
        starts.append(len(ids))
        n = max(1, len(found) - WINDOW + 1)
        begin += range(len(ids), len(ids) + n)
        size += [min(WINDOW, len(found))] * n
        ids += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in found]
        ids.append(0)
    texts, at, run = np.array(ids, np.int64), np.array(begin, np.int64), np.array(size, np.int64)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Queries({}, [], none, none, none, none, none, none, np.zeros(1, np.int64), WINDOW)
    # suffix order puts equal windows side by side
    sa, _ = suffix_array(texts, 1)
    length = np.zeros(len(texts), np.int64)
    length[at] = run
    places = sa[length[sa] > 0]
    rows = np.column_stack([_rows(texts, places, length[places]), length[places]])
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
    unique, lengths = rows[new][:, :WINDOW], rows[new][:, WINDOW]
    high = np.where(np.arange(WINDOW) < lengths[:, None], unique, 0xFFFFFFFF)
    first = np.append(np.flatnonzero(new), len(places))
    return Queries(vocabulary, item_ids, texts, np.array(starts, np.int64), lengths, _keys(unique), _keys(high), places, first, int(run.min()))


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Queries]:
    held, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "") * 2
        if size >= block_bytes:
            yield prepare(held)
            held, size = [], 0
    if held:
        yield prepare(held)


@dataclass
class Shard:
    ids: np.ndarray  # word ids of all documents, a 0 after each
    starts: np.ndarray
    suffixes: np.ndarray  # positions in the order of what begins there
    keys: np.ndarray


def shard(found: list[list[bytes]], q: Queries) -> Shard:
    """The suffix array of a run of documents, given as words."""
    get, counts = q.vocabulary.get, np.array([len(x) for x in found], np.int64)
    parts = []
    for x in found:
        parts.append(np.fromiter(map(get, x, repeat(0)), np.int64, len(x)))
        parts.append(np.zeros(1, np.int64))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(counts + 1)[:-1]]).astype(np.int64)
    return Shard(ids, starts, *suffix_array(ids, q.least))


def occurrences(s: Shard, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of every place in the shard where a window occurs."""
    lo, hi = np.searchsorted(s.keys, q.low, "left"), np.searchsorted(s.keys, q.high, "right")
    n = hi - lo
    window = np.repeat(np.arange(len(n)), n)
    return window, s.suffixes[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def _spread(window: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of window: its index, again and again, with each place of that window in the items."""
    n = q.first[window + 1] - q.first[window]
    return np.repeat(np.arange(len(window)), n), q.places[np.repeat(q.first[window], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def _extended(ids: np.ndarray, at: np.ndarray, texts: np.ndarray, place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many words are equal from ids[at] and texts[place] on, n of them being known to be."""
    n, growing, columns = n.copy(), np.arange(len(at)), np.arange(STRIDE)
    while len(growing):
        a = ids[np.minimum((at[growing] + n[growing])[:, None] + columns, len(ids) - 1)]
        b = texts[np.minimum((place[growing] + n[growing])[:, None] + columns, len(texts) - 1)]
        differ = (a != b) | (a == 0)
        more = np.where(differ.any(axis=1), differ.argmax(axis=1), STRIDE)
        n[growing] += more
        growing = growing[more == STRIDE]
    return n


def longest_each(s: Shard, q: Queries, window: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence the words of its longest match with any item, and that match's place in the items."""
    lo, hi = q.first[window].copy(), q.first[window + 1].copy() - 1
    low = q.lengths[window]
    best = q.places[lo]
    n = _extended(s.ids, at, q.texts, best, low)
    # the suffixes of one window are sorted, so what is next to the place where ours belongs matches it the longest
    active = np.flatnonzero((lo < hi) & (low == WINDOW))
    while len(active):
        mid = (lo[active] + hi[active] + 1) // 2
        k = _extended(s.ids, at[active], q.texts, q.places[mid], low[active])
        better = k > n[active]
        n[active[better]], best[active[better]] = k[better], q.places[mid][better]
        # an item that has ended sorts before; a word that no item has is 0 and sorts before as well
        ours, theirs = s.ids[at[active] + k], q.texts[q.places[mid] + k]
        right = (ours > theirs) | ((ours == theirs) & (ours == 0))
        lo[active] = np.where(right, mid, lo[active])
        hi[active] = np.where(right, hi[active], mid - 1)
        active = active[lo[active] < hi[active]]
    return n, best


@dataclass
class Found:
    """What a run of documents shares with the benchmark."""

    counts: np.ndarray  # words of each text
    marks: np.ndarray  # whether each word of all texts is hit (with a 0 after each text)
    items: list[set]  # item_ids of each text
    longest: np.ndarray  # words of each text's longest match, 0 without one
    longest_at: np.ndarray  # its first word in the text
    n_hit: np.ndarray


def search(texts: list, queries: list[Broadcast]) -> Found:
    """Look texts up in all blocks (broadcast or plain), one after the other."""
    words_of = [words(t) for t in texts]
    counts = np.array([len(x) for x in words_of], np.int64)
    total = int(counts.sum()) + len(counts)
    marked, items = np.zeros(total, bool), [set() for _ in texts]
    longest, longest_at = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for block in queries:
        q = block.value if isinstance(block, Broadcast) else block
        s = shard(words_of, q)
        if len(s.suffixes) and len(q.lengths):
            window, at = occurrences(s, q)
            marks = np.zeros(total + 1, np.int64)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + q.lengths[window], -1)
            marked |= np.cumsum(marks)[:-1] > 0
            doc = np.searchsorted(s.starts, at, "right") - 1
            pairs = np.unique(doc * len(q.lengths) + window)
            index, place = _spread(pairs % len(q.lengths), q)
            for d in np.unique((pairs // len(q.lengths))[index] * len(q.item_ids) + np.searchsorted(q.starts, place, "right") - 1).tolist():
                items[d // len(q.item_ids)].add(q.item_ids[d % len(q.item_ids)])
            n, _ = longest_each(s, q, window, at)
            # the longest of each document, the first of these
            order = np.lexsort((at, -n, doc))
            top = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])] if len(order) else order
            inside = at[top] - s.starts[doc[top]]
            better = (n[top] > longest[doc[top]]) | ((n[top] == longest[doc[top]]) & (inside < longest_at[doc[top]]))
            top, inside = top[better], inside[better]
            longest[doc[top]], longest_at[doc[top]] = n[top], inside
        if len(queries) > 1 and isinstance(block, Broadcast):
            del q, block._value  # a task holds one block at a time
    n_hit = np.add.reduceat(marked.astype(np.int64), np.cumsum(counts + 1) - counts - 1) if len(texts) else counts
    return Found(counts, marked, items, longest, longest_at, n_hit)


def longest(texts: list, q: Queries) -> list[tuple[int, object, int, int, int]]:
    """(text's index, item_id, item word, text word, words) of every verbatim match that goes on on neither side."""
    s = shard([words(t) for t in texts], q)
    if not len(s.suffixes) or not len(q.lengths):
        return []
    window, at = occurrences(s, q)
    index, place = _spread(window, q)
    at, n = at[index], q.lengths[window[index]]
    # a match that also holds one word before is part of that longer one
    begins = (at == 0) | (place == 0) | (s.ids[at - 1] == 0) | (s.ids[at - 1] != q.texts[place - 1])
    at, place = at[begins], place[begins]
    n = _extended(s.ids, at, q.texts, place, n[begins])
    doc, item = np.searchsorted(s.starts, at, "right") - 1, np.searchsorted(q.starts, place, "right") - 1
    return [(int(d), q.item_ids[i], int(p - q.starts[i]), int(a - s.starts[d]), int(k)) for d, i, p, a, k in zip(doc, item, place, at, n, strict=True)]


def _sent(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> list[Broadcast]:
    """The blocks, broadcast one by one: the driver's copy of each lies in a file."""
    return [docs.sparkSession.sparkContext.broadcast(q) for q in blocks(benchmark, block_bytes)]


def _shard_bytes(sent: list[Broadcast]) -> int:
    """Shards of several passes are larger, so that blocks are loaded less often."""
    return SHARD_BYTES * (1 + (len(sent) > 1))


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, item_word, doc_word, n_words: the longest verbatim matches and where they are."""
    sent = _sent(docs, benchmark, block_bytes)
    types = [docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType]
    arrow = [*map(to_arrow_type, types), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "item_id", "item_word", "doc_word", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=SHARD_BYTES):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for block in sent:
                found = longest(texts, block.value)
                columns = list(zip(*((ids[d], i, p, a, n) for d, i, p, a, n in found), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=names)
                if len(sent) > 1:
                    del block._value

    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, [*types, *[T.LongType()] * 3], strict=True)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items if i is not None)).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest match), longest_at (its first word in the
    text; null without a match) for every row of docs."""
    sent = _sent(docs, benchmark, block_bytes)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=_shard_bytes(sent)):
            f = search(batch.column(1).to_pylist(), sent)
            verdict = (f.n_hit > 0) & (SHARE * f.n_hit >= f.counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(f.counts), pa.array(f.n_hit), pa.array([len(x) for x in f.items], pa.int64()), pa.array([_digest(x) for x in f.items]), pa.array(verdict), pa.array(f.longest), pa.array(f.longest_at, mask=f.longest == 0)],
                names=names,
            )

    types = [docs.schema["doc_id"].dataType, *[T.LongType()] * 3, T.StringType(), T.BooleanType(), *[T.LongType()] * 2]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, share: int | None = None) -> DataFrame:
    """docs without the affected rows, with all columns: those with any match, or, where share is given, those with one word in `share` hit."""
    sent = _sent(docs, benchmark, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=_shard_bytes(sent)):
            f = search(batch.column(batch.schema.get_field_index("text")).to_pylist(), sent)
            yield batch.filter(pa.array((f.longest == 0) if share is None else (f.n_hit == 0) | (share * f.n_hit < f.counts)))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
with lowered as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
d as (select row_number() over () r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from lowered),
b as (select row_number() over () q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select q, item_id, p ip, least(13, len(w)) k, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') win from (select q, item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) p from b where len(w) > 0)),
dw as (select r, p, k, array_to_string(w[p : p + k - 1], ' ') win from (select r, w, k, unnest(range(1, len(w) - k + 2)) p from d, (select distinct k from bw) where len(w) >= k)),
m as (select r, p, dw.k, q, ip, item_id from dw join bw on dw.win = bw.win and dw.k = bw.k),
h as (select r, count(distinct z) n_hit from (select r, unnest(range(p, p + k)) z from (select distinct r, p, k from m)) group by r),
i as (select r, count(*) n_items, sha256(coalesce(string_agg(s, ',' order by s), '')) sha from (select distinct r, cast(item_id as varchar) s from m) group by r),
islands as (select r, k, p, p - row_number() over (partition by r, q, p - ip order by p) island, q, p - ip diagonal from m),
runs as (select r, min(p) - 1 place, count(*) + k - 1 n from islands group by r, k, q, diagonal, island),
l as (select r, max(n) longest, arg_max(place, n * 1000000000 - place) longest_at from runs group by r)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(sha, sha256('')) items_sha256,
  coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) contaminated, cast(coalesce(longest, 0) as bigint) longest, cast(longest_at as bigint) longest_at
from d left join h using (r) left join i using (r) left join l using (r)
"""
