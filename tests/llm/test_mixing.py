import heapq
import math
import pickle
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import mixing


def test_codes_are_prefix_codes():
    code = mixing.huffman(np.array([5.0, 1, 1, 2, 9, 1]))
    words = ["".join(map(str, code.bits[code.first[s] : code.first[s + 1]])) for s in range(6)]
    assert sum(2.0 ** -len(w) for w in words) == 1 and len(set(words)) == 6
    assert not any(a != b and b.startswith(a) for a in words for b in words)
    assert len(words[4]) == min(map(len, words))


def test_all_decisions_of_a_token_are_mixed():
    """Tokens whose codes part late only are told apart by the mixed decisions."""
    n = 1 << 14
    code = mixing.lexicon([b"w%d" % i for i in range(n - 1)] + [mixing.END], np.ones(n), 1).code
    words = {code.bits[code.first[s] : code.first[s + 1]].tobytes() for s in range(n + 1)}
    assert len(words) == n + 1


def model(texts):
    found = [mixing.tokens(t) for t in texts]
    counts = Counter(t for x in found for t in x)
    top = [(t, c) for t, c in counts.most_common() if c > 1]
    lex = mixing.lexicon([t for t, _ in top], np.array([c for _, c in top]), sum(counts.values()) - sum(c for _, c in top))
    into = mixing.no_counts()
    mixing.count(mixing.read(found, lex, match=False), lex, into)
    return mixing.Model(lex, [mixing.stretched(*t.reshape(2, -1)) for t in into], np.tile(np.array([0.4, 0.4, 0.3, 0.5], np.float32), (mixing.GATES, 1)), np.full(len(mixing.BYTE_CONTEXTS), 0.5, np.float32))


@pytest.fixture(scope="module")
def texts(sample):
    return [r.text for r in sample.collect()]


@pytest.fixture(scope="module")
def trained(texts):
    return model(texts)


def length(m, some):
    """Bits of the decisions, and of the escapes' spelling."""
    return coded(mixing.read([mixing.tokens(t) for t in some], m.lex), m, len(some))


def coded(s, m, n):
    spelled = mixing.spelled(s, m)[s.rare_id] if len(s.rare) else np.zeros(0)
    return mixing.bits(s, m, n) - np.bincount(s.doc[s.spelled], spelled, minlength=n) / math.log(2)


def sequential(found, m):
    """mixing.bits() of one text, decision by decision in plain Python."""
    code, rank, escape = m.lex.code, m.lex.number, len(m.lex.number)
    symbols = [rank.get(t, escape) for t in found]
    classes = [int(m.lex.context[x]) if x != escape else mixing._suffix(t) for t, x in zip(found, symbols, strict=True)]
    w = [[[float(v) for v in gate] for gate in m.weights]][0]
    steps = [[[0.0] * mixing.INPUTS for _ in w], [0] * len(w)]
    total, block = 0.0, 0
    slot = lambda context, node, k: int(mixing._slot(mixing._hashed(np.array([context], np.int64).astype(np.int32)), np.array([0]), np.array([node], np.int32), mixing.BITS[k])[0])
    for at, x in enumerate(symbols):
        if int(math.log2(at / mixing.BLOCK + 1)) != block:
            for g, n in enumerate(steps[1]):
                for j in range(mixing.INPUTS):
                    w[g][j] += steps[0][g][j] * mixing.RATE / math.sqrt(max(n, 1))
            steps, block = [[[0.0] * mixing.INPUTS for _ in w], [0] * len(w)], block + 1
        one = symbols[at - 1] + 1 if at else 0
        two = symbols[at - 2] + 1 if at > 1 else 0
        contexts = (classes[at - 1] if at else mixing.OWN_CONTEXT, (one * 0x2545F491 + two * 0x9E3779B1 + 1) & 0xFFFFFFFF)
        seen = [i for i in range(2, at) if found[i - 2] == found[at - 2] and found[i - 1] == found[at - 1]] if at >= 2 else []
        guess = symbols[seen[-1]] if seen else None
        path = lambda y: range(code.first[y], code.first[y + 1])
        expected = {int(code.nodes[i]): int(code.bits[i]) for i in path(guess)} if guess is not None else {}
        for i in path(x):
            node, bit = int(code.nodes[i]), int(code.bits[i])
            inputs = [float(code.stretch[i]), *(float(m.stretch[k][slot(c, node, k)]) for k, c in enumerate(contexts)), 2.0 * expected[node] - 1 if node in expected else 0.0]
            g = int(code.gate[i]) + (mixing.GATES // 2 if node in expected else 0)
            z = sum(a * b for a, b in zip(w[g], inputs, strict=True))
            p = 1 / (1 + math.exp(-z if bit else z))
            total -= math.log2(p)
            for j, a in enumerate(inputs):
                steps[0][g][j] += (1 - p) * (2 * bit - 1) * a
            steps[1][g] += 1
    return total


def test_against_a_sequential_mixer(trained, texts):
    draw = np.random.default_rng(2)
    some = [t for t in texts if t][:6] + [" ".join(draw.choice(texts[1].split()[:12], 150)), "", "zq " * 40, "neverseen " + texts[2]]
    for t in some:
        found = mixing.tokens(t)[:400]
        got = mixing.bits(mixing.read([found], trained.lex), trained, 1)[0]
        assert abs(got - sequential(found, trained)) < 2e-3 * max(1.0, got)


def test_recalled():
    draw = np.random.default_rng(4)
    lex = mixing.lexicon([b"a", mixing.END], np.array([5, 3]), 2)
    found = [[*(draw.choice([b"a", b"x", b"y", b"z"], 60).tolist()), mixing.END] for _ in range(5)]
    s = mixing.read(found, lex)
    gate, share = mixing.recalled(s)
    want = []
    for text in found:
        before = []
        for t in text:
            if t not in lex.number:
                want.append((min(math.ceil(math.log2(len(before) + 1)), mixing.ESCAPE_GATES - 1), before.count(t) / max(len(before), 1)))
                before.append(t)
    assert np.allclose(np.column_stack([gate, share]), want)
    w = mixture = mixing.mixture(gate, np.column_stack([share * 0, share, share * 0 + 0.01]))
    assert np.allclose(w.sum(axis=1), 1) and mixture[0, 1] == 0 and (w[5] @ [0, 0.3, 0.01] > 0.1)


def test_a_text_costs_the_same_in_any_company(trained, texts):
    alone = np.array([length(trained, [t])[0] for t in texts[:20]])
    assert np.allclose(length(trained, texts[:20]), alone, rtol=1e-4)


def test_bits_are_a_distribution(trained):
    """The next decision's two values share one: over all tokens of the lexicon and the escape, probabilities sum to 1."""
    m = trained
    length_of = lambda x: coded(mixing.read([x], small), m, 1)[0]
    small = mixing.lexicon([b"a", b"b", mixing.END], np.array([5, 3, 2]), 2)
    m = mixing.Model(small, m.stretch, m.weights, m.byte_weights)
    for prefix in ([], [b"a"], [b"a", b"b", b"a", b"b"]):
        base = length_of(prefix) if prefix else 0.0
        total = sum(2 ** -(length_of([*prefix, t]) - base) for t in (b"a", b"b", mixing.END))
        spelled = [2 ** -(length_of([*prefix, bytes([c])]) - base) for c in range(256) if bytes([c]) not in small.number and c != 32]
        assert total + sum(spelled) < 1 + 1e-3


def test_repetition_and_seen_text_are_cheap(trained, texts):
    seen = texts[0]
    shuffled = " ".join(np.random.default_rng(1).permutation(seen.split()))
    assert length(trained, [seen])[0] < length(trained, [shuffled])[0] * 1.02
    phrase = " ".join(w for w in seen.split() if w.lower().encode() in trained.lex.number)[:60].rsplit(" ", 1)[0] + " "
    once, many = length(trained, [phrase])[0], length(trained, [phrase * 20])[0]
    assert many < 0.7 * 20 * once


def test_previous():
    key = np.array([3, 1, 3, 3, 1, 7])
    now, last = mixing._previous(key)
    assert sorted(zip(now.tolist(), last.tolist(), strict=True)) == [(2, 0), (3, 2), (4, 1)]


def test_report(frame, sample):
    docs = [r.text for r in sample.collect()] + ["", None, "neverseenword " * 3, "Ünï cödé x\x1cy"]
    rows = {r.doc_id: r for r in mixing.report(frame(docs), most_tuning=20).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    found = {i: mixing.tokens(t) for i, t in enumerate(docs)}
    counts = Counter(t for i, x in found.items() if not held(i) for t in x)
    n, v = sum(counts.values()), len(counts)
    for i, x in found.items():
        r = rows[i]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(x), sum(counts[t] > 0 for t in x), n)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base))
        assert r.score < 0 and r.bits_per_byte > 0


def test_unknown_words_get_cheap_when_they_come_again(frame, sample):
    """So does a word outside the lexicon that the training texts hold."""
    docs = [r.text for r in sample.collect()] + ["zq wv kj xx pq rr", "zq wv kj xx pq rr " * 20, "once", "once again"]
    rows = {r.doc_id: r for r in mixing.report(frame(docs), most_tuning=20).collect()}
    assert rows[len(docs) - 3].score > 0.35 * 20 * rows[len(docs) - 4].score


def test_very_long_texts_and_other_columns(frame):
    words = [f"w{i % 700}" for i in range(150_000)]
    rows = {r.doc_id: r for r in mixing.report(frame([" ".join(words), "w1 w2", None])).collect()}
    assert rows[0].n_tokens == 150_001 and rows[0].score > 5 * rows[0].base_score / 6


def test_held_out_texts_are_better_told_than_by_the_base(spark):
    rows = mixing.report(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").selectExpr("sum(score)", "sum(base_score)", "sum(n_tokens)").first()
    assert rows[0] > rows[1] + 0.3 * rows[2]


def test_edges(frame):
    assert mixing.report(frame([])).collect() == []
    rows = mixing.report(frame([(5, "a b"), (5, "a b"), (None, None)])).collect()
    assert len(rows) == 3 and len({r.score for r in rows if r.doc_id == 5}) == 1
    for texts in ([(1, "a b c")], [(i, None) for i in range(3)], [(i, "x y") for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]):
        counts = Counter(t for i, x in texts if zlib.crc32(str(i).encode()) % 10 for t in mixing.tokens(x))
        n, v = sum(counts.values()), len(counts)
        for r in mixing.report(frame(texts)).collect():
            own = mixing.tokens(dict(texts)[r.doc_id])
            assert abs(r.base_score - sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)) < 1e-9
            assert (r.n_known, r.train_tokens) == (sum(counts[t] > 0 for t in own), n)


def test_all_training_texts_teach(frame, monkeypatch):
    """Every training text is in the hashed counts and in the fit of the weights, and every escape in that of its weights."""
    made = {}
    tables, mixture = mixing.tables, mixing.mixture
    monkeypatch.setattr(mixing, "fitted", lambda said, fit=mixing.fitted: (made.update(said=[int(x.sum()) for x in said]), fit(said))[1])
    monkeypatch.setattr(mixing, "tables", lambda *a: made.setdefault("model", tables(*a)))
    monkeypatch.setattr(mixing, "mixture", lambda gate, sources, **a: (made.update(escapes=a["times"].sum()), mixture(gate, sources, **a))[1])
    draw = np.random.default_rng(6)
    docs = [" ".join(f"w{k}" for k in draw.integers(0, 400, 30)) for _ in range(300)] + ["one two " * 30]
    mixing.report(frame(docs)).collect()
    m = made["model"]
    training = [mixing.tokens(t) for i, t in enumerate(docs) if zlib.crc32(str(i).encode()) % 10]
    s = mixing.read(training, m.lex)
    into = mixing.no_counts()
    mixing.count(s, m.lex, into)
    assert all((mixing.stretched(*t) == x).all() for t, x in zip(into, m.stretch, strict=True))
    assert made["said"][0] == len(mixing._expand(m.lex.code, s.symbol)[0]) and made["escapes"] == len(s.spelled)


def test_what_is_said_before_counting(texts):
    """Levels by what the earlier texts' counts say, decision by decision."""
    lex = model(texts).lex
    into, said, own = mixing.no_counts(), mixing.nothing_said(), mixing.own_levels(lex.code)
    first, then = (mixing.read([mixing.tokens(t) for t in some], lex) for some in (texts[:40], texts[40:43]))
    mixing.count(first, lex, into)
    before = [t.copy() for t in into]
    mixing.count(then, lex, into, said, own)
    m = mixing.Model(lex, [mixing.stretched(*t).astype(np.float32) for t in before], np.zeros((8, 4)), np.zeros(2))
    _, x, bit, gate, on, says = mixing._token_inputs(then, m, np.arange(len(then.symbol)))
    level = lambda v, step, most: np.clip(np.rint(v.astype(np.float32) / step), -most, most).astype(int) + most
    spoken = np.zeros(len(bit), int)
    spoken[on] = (says > 0) + 1
    exact = [np.log((b[1] + mixing.ADD) / (b[0] + mixing.ADD)) for b in before]
    exact = mixing._token_inputs(then, m._replace(stretch=exact), np.arange(len(then.symbol)))[1]
    cells = (gate % 4, spoken, level(x[0], np.float32(mixing.OWN_STEP), mixing.OWN_LEVELS), *(level(e, mixing.STEP, mixing.LEVELS) for e in exact[1:]), bit)
    want = np.bincount(np.ravel_multi_index(cells, mixing.SAID), minlength=len(said[0]))
    assert said[0].sum() == want.sum() and np.abs(said[0] - want).sum() < 0.01 * want.sum()


def test_fitted_weights():
    """Bits drawn from known weights give these back."""
    draw = np.random.default_rng(5)
    said = mixing.nothing_said()
    a, b = (draw.integers(-6, 7, 200_000) for _ in range(2))
    for k, shape in enumerate((mixing.SAID, mixing.SAID_BYTES)):
        p = 1 / (1 + np.exp(-mixing.STEP * (0.7 * a + 0.3 * b)))
        cells = [a + mixing.LEVELS, b + mixing.LEVELS, (draw.random(len(a)) < p).astype(int)]
        cells = cells if k else [np.zeros_like(a), np.zeros_like(a), np.full_like(a, mixing.OWN_LEVELS), *cells]
        said[k] += np.bincount(np.ravel_multi_index(cells, shape), minlength=len(said[k]))
    weights, byte_weights = mixing.fitted(said)
    assert np.allclose(weights[0, 1:3], [0.7, 0.3], atol=0.03) and np.allclose(byte_weights, [0.7, 0.3], atol=0.03)
    assert np.allclose(weights[7], [0.4, 0.4, 0.4, 0.5])  # nothing seen


def test_what_is_sent(trained, texts):
    """The model comes back as it was from much fewer bytes: every executor keeps them on disk."""
    counts = tuple(np.random.default_rng(1).integers(0, 3, (2, 1 << b)).astype(np.float32) for b in mixing.BITS[2:])
    m = trained._replace(byte_counts=counts, stretch=[*trained.stretch[:2], *(mixing.stretched(*c) for c in counts)])
    sent = pickle.dumps(m)
    back = pickle.loads(sent)
    assert back.lex.number == m.lex.number and all((a == b).all() for a, b in zip([*back.lex.code, *back.lex.byte_code, *back.byte_counts], [*m.lex.code, *m.lex.byte_code, *m.byte_counts], strict=True))
    assert np.allclose(length(back, texts[:10]), length(m, texts[:10]))
    assert len(pickle.dumps(back.lex)) < sum(a.nbytes for a in m.lex.code) / 2


def test_spelled_alone(texts):
    """As if the token's own occurrences had not been counted."""
    m = model(texts[:30])
    known = [[*mixing.tokens(t)[:-1], *x, mixing.END] for t, x in zip(texts[:30], [[b"qqvx"] * 2, *[[b"qqvz"]] * 29], strict=True)]
    with_it, without = mixing.no_counts(), mixing.no_counts()
    mixing.count(mixing.read(known, m.lex), m.lex, with_it)
    mixing.count(mixing.read([[t for t in x if t != b"qqvx"] for x in known], m.lex), m.lex, without)
    s = mixing.read(known, m.lex)
    which = np.array([s.rare.index(b"qqvx")])
    other = m._replace(stretch=[np.log((t[1] + mixing.ADD) / (t[0] + mixing.ADD)).astype(np.float32) for t in without])
    got = mixing.spelled_alone(s, m._replace(byte_counts=tuple(with_it[2:])), which, np.array([2]))
    assert np.allclose(got, mixing.spelled(s, other)[which], rtol=1e-3)


def test_long_words_cost_what_their_spelling_costs(frame, sample):
    """A word whose probability is below any double is not free."""
    draw = np.random.default_rng(3)
    word = "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 4000))
    docs = [r.text for r in sample.collect()]
    held = [i for i in range(len(docs), len(docs) + 60) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = {r.doc_id: r.score for r in mixing.report(frame([*enumerate(docs), (held[0], word[:40]), (held[1], word)])).collect()}
    assert rows[held[1]] < 30 * rows[held[0]] < 0


def test_split_is_tokens(texts):
    """All texts at once by Arrow, from any slice of a column."""
    odd = ["A b", "", None, "  x ", " ", "\x1c y\x0bz\x0c", "Ünï CÖ d e f", "a b a\n", "\t\r\n", "İ ẞ K"] + texts[:50]
    want = mixing.gathered([mixing.tokens(t) for t in odd])
    for kind in (pa.string(), pa.large_string()):
        got = mixing.split(pa.array(["before", *odd, "after"], kind).slice(1, len(odd)))
        assert got.distinct == want.distinct and (got.which == want.which).all() and (got.sizes == want.sizes).all()
    none = mixing.split(pa.array([], pa.string()))
    assert len(none.sizes) == len(none.which) == 0 and none.distinct == []


def test_the_tree_is_the_heap_s():
    """Of equal weights the leaf goes first, then what was made first."""
    for n in (1, 2, 3, 50, 3000):
        weights = np.random.default_rng(n).integers(1, 20, n).astype(float)
        heap, parent = [(w, i) for i, w in enumerate(weights.tolist())], np.zeros(2 * n, np.int32)
        heapq.heapify(heap)
        for node in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = node
            heapq.heappush(heap, (a + b, node))
        assert (mixing.tree(weights)[0] == parent).all()


def test_the_driver_holds_little(frame, sample, monkeypatch):
    """It only sends the code, unfolded where it is used, and takes the tables chunk by chunk."""

    def refused(*a):
        raise AssertionError("the driver needs no unfolded code")

    monkeypatch.setattr(mixing, "unfolded", refused)
    tracemalloc.start()
    try:
        rows = mixing.report(frame([r.text for r in sample.collect()]))
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
    assert all(r.score < 0 for r in rows.collect())
