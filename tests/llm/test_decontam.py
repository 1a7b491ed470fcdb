import hashlib
import random

import numpy as np

from tessera.llm import decontam


def brute(text, items):
    w = decontam.words(text)
    hit, found, longest = set(), set(), (0, None)
    for item_id, t in items:
        q = decontam.words(t)
        k = min(13, len(q))
        windows = {}
        for i in range(len(q) - k + 1 if q else 0):
            windows.setdefault(tuple(q[i : i + k]), []).append(i)
        for i in range(len(w) - k + 1):
            for j in windows.get(tuple(w[i : i + k]), []):
                hit |= set(range(i, i + k))
                found.add(item_id)
                n = k
                while i + n < len(w) and j + n < len(q) and w[i + n] == q[j + n]:
                    n += 1
                if n > longest[0] or n == longest[0] and i < longest[1]:
                    longest = (n, i)
    digest = hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w), *longest


def case():
    draw = random.Random(4)
    vocabulary = ["the", "of", "É", "x1", "öl", "a", "zz", "q"]
    say = lambda n: " ".join(draw.choice(vocabulary) + draw.choice(["", ",", "."]) for _ in range(n))
    items = [(i, say(draw.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(12)] + [(100, None), (101, ""), (102, "!!"), (103, "THE of")]
    # items that share beginnings, so that the longest match is one of several with the same window
    stem = say(20)
    items += [(200 + i, stem + " " + say(i)) for i in range(6)] + [(None, "null item " + stem), (3, "again " + stem)]
    texts = [say(draw.randrange(0, 120)) for _ in range(40)]
    texts += [say(10) + " " + items[k][1] + " " + say(k) for k in range(12)] + ["", None, "...", items[6][1].upper(), "word " * 3000 + items[5][1]]
    texts += [say(5) + " " + stem + " " + items[16 + i][1] + " x" for i in range(6)] + ["null item " + stem, "the of " * 200]
    return texts, items


def rows_of(found):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.longest, r.longest_at) for r in found.collect()}


def test_against_brute_force(spark, frame):
    texts, items = case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute(t, items) for i, t in enumerate(texts)}
    for size in (1 << 20, 40):  # one block; many
        assert rows_of(decontam.report(frame(texts), benchmark, size)) == want
        assert {r.doc_id for r in decontam.clean(frame(texts), benchmark, size).collect()} == {i for i, w in want.items() if not w[1]}
        assert {r.doc_id for r in decontam.clean(frame(texts), benchmark, size, share=20).collect()} == {i for i, w in want.items() if not w[4]}


def test_suffix_order():
    draw = np.random.default_rng(3)
    for least in (1, 4, 13):
        for _ in range(20):
            ids = np.append(draw.integers(0, 3, 400) + (draw.random(400) < 0.9), 0)
            ids[50:250:60] = 0
            ids[100:200] = ids[250:350]  # long ties
            sa, _ = decontam.suffix_array(ids, least)

            def suffix(i, ids=ids):
                end = i
                while ids[end]:
                    end += 1
                return ids[i:end].tolist()

            assert all(suffix(a) <= suffix(b) for a, b in zip(sa, sa[1:], strict=False))
            stretches = np.split(np.arange(len(ids)), np.flatnonzero(ids == 0))
            assert sorted(sa) == [i for part in stretches for own in [[j for j in part if ids[j]]] if len(own) >= least for i in own]


def test_a_passage_in_a_long_text_goes(spark, frame):
    """A few words in thousands are below the share of the verdict, and yet the document is affected."""
    passage = " ".join(f"b{i}" for i in range(40))
    texts = [" ".join(["w"] * 1000 + passage.split()[5:25] + ["v"] * 1000), "w " * 2000, passage[: len(passage) // 4]]
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert {r.doc_id for r in decontam.clean(frame(texts), benchmark).collect()} == {1, 2}
    rows = {r.doc_id: r for r in decontam.report(frame(texts), benchmark).collect()}
    assert (rows[0].n_hit, rows[0].contaminated, rows[0].longest, rows[0].longest_at) == (20, False, 20, 1000)


def test_longest_matches():
    q = decontam.prepare([(1, " ".join(f"w{i}" for i in range(30))), (2, "x y")])
    text = "a " + " ".join(f"w{i}" for i in range(3, 25)) + " b x y"
    assert sorted(decontam.longest([text, "none", None], q)) == [(0, 1, 3, 1, 22), (0, 2, 0, 24, 2)]


def test_every_match_is_maximal(spark, frame):
    texts, items = case()
    words = {i: decontam.words(t) for i, t in enumerate(texts)}
    named = {i: [decontam.words(t) for j, t in items if i == j] for i, _ in items}
    for size in (1 << 20, 40):
        rows = decontam.matches(frame(texts), spark.createDataFrame(items, "item_id long, text string"), size).collect()
        best = {}
        for r in rows:
            w, n = words[r.doc_id], r.n_words
            assert any(w[r.doc_word : r.doc_word + n] == q[r.item_word : r.item_word + n] and n >= min(13, len(q)) and (r.item_word + n == len(q) or r.doc_word + n == len(w) or q[r.item_word + n] != w[r.doc_word + n]) for q in named[r.item_id])
            best[r.doc_id] = max(best.get(r.doc_id, 0), n)
        assert best == {i: w[5] for i, t in enumerate(texts) if (w := brute(t, items))[5]}


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("d1", "one two three"), (None, "x")], "doc_id string, text string")
    benchmark = spark.createDataFrame([("b,1", "two three"), ("b2", "x")], "item_id string, text string")
    for size in (1 << 20, 1):
        rows = {r.doc_id: r for r in decontam.report(docs, benchmark, size).collect()}
        assert rows["d1"].items_sha256 == hashlib.sha256(b"b,1").hexdigest() and rows[None].n_items == 1
        assert sorted((str(r.doc_id), r.item_id, r.n_words) for r in decontam.matches(docs, benchmark, size).collect()) == [("None", "b2", 1), ("d1", "b,1", 2)]


def test_empty_tables_and_repeated_rows(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(frame([]), none).collect() == []
    assert [(r.n_words, r.n_hit, r.contaminated, r.longest, r.longest_at) for r in decontam.report(frame(["a b"]), none).collect()] == [(2, 0, False, 0, None)]
    assert decontam.clean(frame(["a b"]), none).columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert len({tuple(r) for r in decontam.report(frame([(1, "a b"), (1, "a b")]), some).collect()}) == 1
    assert decontam.report(frame([]), some).collect() == [] and decontam.clean(frame([]), some).collect() == []
