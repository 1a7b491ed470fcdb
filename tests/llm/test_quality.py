import re
from collections import Counter

import numpy as np

from tessera.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i, k in enumerate(zip(w, w[1:], w[2:], strict=False)) if three[k] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


TEXTS = ["", None, " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "é ñ 😀 z", "l1\nl1\n\nl1 \n", "a|b #c <d> %%%\r\nq", "a b c d " * 2000, "\x0b\x0c\x1c z\x85", "one line " * 3 + "\n" + "one line " * 3]


def test_statistics_are_exact(sample):
    texts = TEXTS + [r.text for r in sample.collect()]
    s = quality.statistics(texts)
    assert list(zip(*(c.tolist() for c in s[:5]), strict=True)) == [brute(t) for t in texts]
    one = [quality.statistics([t]) for t in texts[:30]]
    assert all(np.array_equal(o.features[0], f) for o, f in zip(one, s.features[:30], strict=True))


def test_many_distinct_words():
    ids = np.array([0, 1, 2, 0, 1, 2, 3], np.int64)
    doc = np.zeros(7, np.int64)
    assert quality._repeated(ids, doc, 1, 4).tolist() == quality._repeated(ids, doc, 1, 1 << 24).tolist() == [6]


def test_forest_is_monotonic_and_right():
    draw = np.random.default_rng(0)
    x = draw.random((3000, len(quality.FEATURES)))
    k = quality.FEATURES.index("symbols")
    y = ((x[:, k] < 0.5) ^ (draw.random(3000) < 0.05)).astype(float)
    forest = quality.fit(x, y, trees=20)
    assert ((forest.score(x) > 0.5) == (x[:, k] < 0.5)).mean() > 0.95
    for name in quality.MONOTONE:
        j = quality.FEATURES.index(name)
        for row in x[:40]:
            line = np.tile(row, (50, 1))
            line[:, j] = np.linspace(-0.5, 1.5, 50)
            assert (np.diff(forest.score(line)) <= 1e-12).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.train(docs, labels)
    import zlib

    told = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    rows = [r for r in quality.report(docs, forest).collect() if r.doc_id in told and not r.base_failed]
    assert np.mean([r.kept == bool(told[r.doc_id]) for r in rows]) > 0.97


def test_edges(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(TEXTS)
    forest = quality.train(docs, labels)
    assert forest is None
    rows = {r.doc_id: r for r in quality.report(docs, forest).collect()}
    assert len(rows) == len(TEXTS) and rows[0].base_failed and not rows[0].kept and rows[11].base_failed
    assert quality.keep(docs, forest).columns == docs.columns
    assert quality.report(frame([]), forest).collect() == []
    null_labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, null_labels) is None
