import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def brute(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=200, deadline=None)
def test_runs_are_best_fit_decreasing(lengths):
    counts = Counter(lengths)
    runs, n = packing.best_fit_decreasing(counts, 40)
    room = [40] * n
    runs.sort(key=lambda r: (-r[0], r[1]))
    for k, (length, rank, first, offset) in enumerate(runs):
        end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else counts[length]
        for j in range(end - rank):
            assert 40 - room[first + j] == offset
            room[first + j] -= length
    assert sorted(room) == brute(lengths, 40)


def test_segment_tree():
    rooms = packing.Rooms(20)
    open_now = set()
    draw = random.Random(2)
    for _ in range(500):
        r = draw.randrange(21)
        rooms.set(r, on := draw.random() < 0.5)
        (open_now.add if on else open_now.discard)(r)
        least = draw.randrange(21)
        assert rooms.tightest(least) == min((x for x in open_now if x >= least), default=None)


def test_ids_are_the_librarys():
    ours, theirs = packing.encoder(public_tokenizers.path("byte_bpe_50k.json")), library()
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for t in [*texts, "", " ", "a\n\n b\t\r\nc  ", "<|endoftext|> x", " <|endoftext|>  y<|endoftext|><|endoftext|>\n", "<|endoftext|", "a<|endoftext|>b", "日本語 é ñ ß 😀", "don't I'll", "x" * 5000, "1234567890" * 50, "\x00\x01"]:
        assert ours(t) == theirs(t)


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


def test_pack(frame):
    texts = [(i, t) for i, t in enumerate(["", None, "a b c", "word " * 40, "word " * 40, "é" * 30, "<|endoftext|>"] + ["x y z " * k for k in range(40)])]
    rows = packing.pack(frame(texts), capacity=16).collect()
    encode, by_doc, by_bin = library(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    for i, t in texts:
        ids = [*encode(t or ""), 0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == [s for s, _ in packing.cut(len(ids), 16)]
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own)
        assert sum(r.length for r in own) == len(ids)
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 16
    assert len(by_bin) == len(brute([r.length for r in rows], 16))


def test_empty_and_repeated(frame):
    assert packing.pack(frame([])).collect() == []
    long = packing.pack(frame([(1, "word " * 400_000)])).collect()
    assert len(long) == -(-400_002 // 2048) and sum(r.length for r in long) == 400_002
    assert len(packing.pack(frame([(1, "a"), (1, "a"), (None, None)])).collect()) == 3
