"""Best-fit decreasing packing of tokenised documents into sequences of a fixed number of tokens.

Every text is turned into ids, an end id follows, and documents longer than a sequence are cut into full pieces (the
first piece takes the remainder). Best-fit decreasing then puts each piece, longest first, into the open sequence with
the least room that still takes it. Pieces of one length are interchangeable and so are sequences with equal room, so
the driver packs the histogram of lengths (at most `capacity` entries): a segment tree over rooms finds the tightest
open room, and runs of pieces move into runs of sequences at once. The runs go back to the executors, where each
piece's gapless rank within its length picks its sequence.

Cases: a null text is the empty one (one piece of the end id alone); repeated rows are packed as rows of their own; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import numbered, slices, stored, table

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"


@lru_cache(maxsize=2)
def encoder(path: str | None):
    """From a text to the ids that the tokenizers library gives with add_special_tokens=False, by a faster engine of byte-level BPE.

    Merges of such a file are ranked by the ids of what they make, so the vocabulary alone fixes the result. As in the
    library's default setting, the strings of the file's added tokens in a text are those tokens, and what lies between them is
    encoded by itself. tests/llm holds the ids against the library. path None: this machine's byte_bpe_50k.json.
    """
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    if odd := [x["content"] for x in spec["added_tokens"] if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]]:
        raise ValueError(f"added tokens that take more than their own string are not served: {odd}")
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    plain = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if not added:
        return plain
    cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(text: str) -> list[int]:
        if not any(map(text.__contains__, added)):
            return plain(text)
        return [i for part in cuts.split(text) for i in ([added[part]] if part in added else plain(part))]

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, before them the remainder."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str | None, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches):
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    for column, value in zip(rows, (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Rooms:
    """A segment tree over the rooms 0..capacity: each node knows whether its span holds a room with open sequences."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.width)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.width
        self.open[i] = is_open
        while i > 1:
            i //= 2
            now = self.open[2 * i] or self.open[2 * i + 1]
            if self.open[i] == now:
                break
            self.open[i] = now

    def tightest(self, least: int) -> int | None:
        """The smallest open room of at least `least`."""
        i = least + self.width
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def best_fit_decreasing(lengths: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """lengths: how many pieces there are of each length. Runs (length, first rank, first sequence, offset), and the number of sequences.

    A run holds until the next run of its length: rank r of it goes to sequence first + (r - first rank).
    """
    rooms, at, runs, n_bins = Rooms(capacity), {}, [], 0
    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, lo, hi = capacity, n_bins, n_bins - (-left // (capacity // length))
                n_bins = hi
            else:
                lo, hi = at[room].pop()
                if not at[room]:
                    rooms.set(room, False)
            # what a sequence has left after one piece is its tightest room, so it takes all it can before the next one does
            per = room // length
            take = min(left, per * (hi - lo))
            full, rest = divmod(take, per)
            for layer in range(per):
                if n := full + (layer < rest):
                    runs.append((length, rank, lo, capacity - room + layer * length))
                    rank += n
            touched = lo + full + (rest > 0)
            for spare, begin, end in ((room - per * length, lo, lo + full), (room - rest * length, lo + full, touched), (room, touched, hi)):
                if end > begin and spare:
                    at.setdefault(spare, []).append((begin, end))
                    rooms.set(spare, True)
            left -= take
    return runs, n_bins


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs. tokenizer: a path on the executors; None: their
    own copy of the public file."""
    cuts = stored(pieces(docs, tokenizer, capacity), "pack-pieces")
    lengths = {r[0]: r[1] for r in cuts.groupBy("length").count().collect()}
    runs, _ = best_fit_decreasing(lengths, capacity)
    runs.sort()
    shift = 44
    packed = docs.sparkSession.sparkContext.broadcast((np.array([(n << shift) + r for n, r, _, _ in runs], np.int64), np.array([r for _, r, _, _ in runs], np.int64), np.array([b for _, _, b, _ in runs], np.int64), np.array([o for *_, o in runs], np.int64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, bins, offsets = packed.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            k = np.searchsorted(keys, (length << shift) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins[k] + rank - ranks[k]), pa.array(offsets[k])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = numbered(cuts, ["length"], ["doc_id", "piece", "ids_crc32", "start"], "rank")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
