import random
from collections import Counter

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import neardup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30), st.integers(0, 30))
@settings(max_examples=300, deadline=None)
def test_edits(a, b, most):
    d = distance(a, b)
    assert neardup.edits(a, b, most) == (d if d <= most else None)


@given(st.lists(st.sampled_from("ab"), min_size=1, max_size=25), st.lists(st.sampled_from("ab"), min_size=1, max_size=25))
@settings(max_examples=200, deadline=None)
def test_links(a, b):
    assert neardup.linked(a, b) == (5 * distance(a, b) <= max(len(a), len(b)))


def test_long_alignments():
    draw = random.Random(1)
    a = [str(draw.randrange(5000)) for _ in range(6000)]
    b = list(a)
    for i in sorted(draw.sample(range(6000), 60), reverse=True):
        b[i : i + 1] = draw.choice([[], ["x"], ["x", b[i]]])
    assert 0 < neardup.edits(a, b, 1200) <= 120


def hashed(found):
    known, sizes = neardup._Hashes(), np.array([len(x) for x in found], np.int64)
    return np.fromiter((known[w] for x in found for w in x), np.uint64, sizes.sum()), sizes


def test_keys_do_not_depend_on_company():
    draw = random.Random(2)
    docs = [[draw.choice([b"a", b"b", b"c", b"d"]) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 6, 50, 200, 7, 24, 25, 64, 65)]
    together, bags = neardup.keys(*hashed(docs)), neardup.bags(*hashed(docs))
    assert all(neardup.keys(*hashed([d]))[0].tolist() == together[i].tolist() and neardup.bags(*hashed([d])) == [bags[i]] for i, d in enumerate(docs))
    a = [b"%d" % i for i in range(200)]
    moved = [x for i in range(0, 200, 4) for x in reversed(a[i : i + 4])][::-1]
    blocks = a[150:] + a[100:150] + a[50:100] + a[:50]
    agree = lambda x: (neardup.sketches(*hashed([a]))[0] == neardup.sketches(*hashed([x]))[0]).mean()
    assert agree(a[:100] + [b"new"] + a[101:]) > 0.8 > agree(blocks) > agree(moved) == 0  # the same k-mers in another order agree less often


@given(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=300), st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=300))
@settings(max_examples=200, deadline=None)
def test_bags_bound_what_is_not_in_common(a, b):
    found = [[x.encode() for x in a], [x.encode() for x in b]]
    x, y = (np.frombuffer(v, np.uint8) for v in neardup.bags(*hashed(found)))
    true = sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values())
    assert neardup.bag_distance(x, y) <= true


def brute_classes(texts):
    words = [neardup.words(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if not words[i] or not words[j]:
                linked = not words[i] and not words[j] and (texts[i] or "") == (texts[j] or "")
            else:
                linked = words[i] == words[j] or 5 * distance(words[i], words[j]) <= max(len(words[i]), len(words[j]))
            if linked:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def corpus():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    passage = say(25)
    texts = []
    for _ in range(6):
        first = say(80)
        texts.append(first)
        for _ in range(5):
            t = list(first)
            for i in draw.sample(range(len(t)), 3):
                t[i] = draw.choice(vocabulary)
            texts.append(t)
    texts += [passage + say(60) for _ in range(15)]  # a passage that unrelated texts share
    hub = say(90)
    texts += [[*hub[: 90 - k], *say(k)] for k in (0, 3, 6, 9)]
    return [" ".join(t) for t in texts] + ["", None, "!!", "??", "!!", "One two.", "one TWO", "a b c d e", "a b c d e f", texts[0] and " ".join(texts[0]).upper()]


def test_classes_against_brute_force(frame):
    texts = corpus()
    want = brute_classes(texts)
    got = {r.doc_id: r for r in neardup.report(frame(texts)).collect()}
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(r.class_size == sum(x.class_id == r.class_id for x in got.values()) for r in got.values())
    kept = neardup.representatives(frame(texts))
    assert kept.columns == frame([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in got.values()})


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    links = spark.createDataFrame([(a, b) for a, b in edges if a != b], "node long, rep long")
    got = {r.node: r.label for r in neardup.components(links).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_edges_of_the_table(frame):
    assert neardup.report(frame([])).collect() == []
    rows = neardup.report(frame([(7, "a b"), (7, "a b"), (None, "c"), (8, "c"), (9, None)])).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.class_size) for r in rows) == [(0, 8, 2), (7, 7, 2), (7, 7, 2), (8, 8, 2), (9, 9, 1)]
    assert sorted(r.doc_id or 0 for r in neardup.representatives(frame([(7, "a b"), (7, "a b"), (None, "c"), (8, "c"), (None, "d")])).collect()) == [0, 7, 8]


def edited(words, rate, draw):
    """A copy with `rate` of its words replaced by new ones."""
    t = list(words)
    for i in draw.sample(range(len(t)), int(len(t) * rate)):
        t[i] = f"n{draw.randrange(10**9)}"
    return t


def test_links_behind_an_unrelated_least_node(frame):
    """Copies that are linked to their original alone: the least node of a bucket is mostly another copy."""
    draw = random.Random(7)
    first = [f"w{draw.randrange(10**6)}" for _ in range(100)]
    texts = [" ".join(t) for t in [first, *(edited(first, 0.17, draw) for _ in range(150))]]
    assert {(r.class_id, r.class_size) for r in neardup.report(frame(texts)).collect()} == {(0, 151)}


def test_recall_at_the_threshold(frame):
    draw = random.Random(8)
    texts, n_pairs = [], 0
    for n in (20, 60, 100, 400):
        for rate in (0.1, 0.15, 0.2):
            for _ in range(20):
                first = [f"w{draw.randrange(10**6)}" for _ in range(n)]
                texts += [" ".join(first), " ".join(edited(first, rate, draw))]
                n_pairs += 1
    every_fifth = [f"v{i}" for i in range(100)]
    texts += [" ".join(every_fifth), " ".join("x" if i % 5 == 4 else w for i, w in enumerate(every_fifth))]
    rows = {r.doc_id: r.class_id for r in neardup.report(frame(texts)).collect()}
    assert sum(rows[2 * i] == rows[2 * i + 1] for i in range(n_pairs + 1)) == n_pairs + 1
    assert len(set(rows.values())) == n_pairs + 1


def test_all_classes_against_brute_force(frame):
    texts = corpus() + ["k l m n o", "k l x n o", "p q r s", "p q z r s"]  # with the short pairs
    got = {r.doc_id: r.class_id for r in neardup.report(frame(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_blocks_of_a_bucket(frame, monkeypatch):
    """Unrelated texts that share a passage and fill several blocks, with links among them."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    draw = random.Random(9)
    passage = [f"p{i}" for i in range(30)]
    firsts = [passage + [f"w{draw.randrange(10**6)}" for _ in range(60 + k % 30)] for k in range(40)]
    texts = [" ".join(t) for t in [*firsts, *(edited(t, 0.18, draw) for t in firsts)]]
    got = {r.doc_id: r.class_id for r in neardup.report(frame(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_a_bucket_joins_each_node_once(frame, monkeypatch):
    """Texts that share a key and lie in several bands of lengths: the joins' rows grow with the bucket, and all pairs within the bound are found."""
    draw, joined, spread_join = random.Random(10), [], neardup.spread_join

    def counting(*args, **more):
        out = spread_join(*args, **more)
        joined.append(out.count())
        return out

    monkeypatch.setattr(neardup, "spread_join", counting)
    say = lambda n: " ".join(f"w{draw.randrange(6)}" for _ in range(n))
    for n, block in ((20, 1024), (40, 1024), (40, 8)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        rows = neardup.nodes(frame([say(draw.randrange(30, 60)) for _ in range(n)]))
        own = {r.row: r for r in rows.collect()}
        known = rows.select(rows.row.alias("node"), "size", "bag", neardup.F.array(neardup.F.lit(5).cast("long")).alias("keys"))
        ends = known.select(neardup.F.lit(5).cast("long").alias("key"), "node")
        joined.clear()
        pairs, most = neardup._untested(ends, known, known.select("node", neardup.F.col("node").alias("label")), n, 0.0, np.inf)
        assert max(joined) == n <= most
        want = set()
        for a in own.values():
            for b in own.values():
                apart = neardup.bag_distance(np.frombuffer(a.bag, np.uint8), np.frombuffer(b.bag, np.uint8))
                if a.row > b.row and 2 * max(a.size, b.size) - (a.size + b.size - apart) <= max(a.size, b.size) // 5 * 2:
                    want.add((a.row, b.row, apart))
        found = [tuple(r) for r in pairs.select("node", "rep", "apart").collect()]
        assert len(found) == len(set(found)) > n and set(found) == want
