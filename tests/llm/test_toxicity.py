import zlib

import numpy as np

from tessera.llm import toxicity


def test_risk_needs_no_negatives():
    """Positives and a mixture, prior known: the classifier finds the positives of the mixture."""
    draw = np.random.default_rng(1)
    doc = lambda toxic: sorted({int(j) for j in draw.integers(5, 60, 12)} | ({int(draw.integers(0, 5))} if toxic else set()))
    truth = draw.random(2000) < 0.2
    mixture = toxicity.Rows([doc(t) for t in truth], 60)
    w, b = toxicity.nnpu(toxicity.Rows([doc(True) for _ in range(300)], 60), mixture, 0.2)
    z = mixture.times(w) + b
    order = z.argsort().argsort() + 1
    auc = (order[truth].sum() - truth.sum() * (truth.sum() + 1) / 2) / truth.sum() / (~truth).sum()
    assert auc > 0.97


def test_score_is_the_weight_of_features():
    weights = {b"=idiot": 2.0, b"1^abcde": 0.5, b"2^abcde": 0.25, b"#1": -0.1}
    m = toxicity.Model(weights, -1.0, 1.0, 0.0, frozenset([b"idiot", b"abcde"]))
    for text in ("An Idiot said abcdef", "abcdef abcdeg x", "", None, "idiots abcde"):
        margin = -1.0 + sum(weights.get(f, 0.0) for f in toxicity.features(text))
        assert abs(m.score(text) - 1 / (1 + np.exp(-margin))) < 1e-12


def test_held_out_rows_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    flipped = spark.createDataFrame([(r.doc_id, 1, 1 - r.toxic if held(r.doc_id) else r.toxic) for r in labels.collect()], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, flipped) == toxicity.train(docs, labels)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    told = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.report(docs, toxicity.train(docs, labels)).collect() if r.doc_id in told and r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.predicted == told[r.doc_id] for r in rows]) > 0.96
    assert np.mean([r.predicted for r in rows if told[r.doc_id]]) > 0.8


def test_edges(spark, frame):
    docs = frame(["a", None, "", "b " * 9])
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, labels) is None
    assert [(r.score, r.predicted) for r in toxicity.report(docs, None).collect()] == [(0.0, 0)] * 4
    assert toxicity.report(frame([]), None).collect() == []
    few = toxicity.train(frame([(i, "bad" if i % 2 else "good") for i in range(40)]), spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int"))
    assert few.score("bad") > few.score("good") and 0 <= few.score(None) <= 1
