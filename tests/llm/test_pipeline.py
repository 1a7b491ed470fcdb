from pyspark.sql import functions as F

import corpus_pipeline

from tessera.llm import catalog, decontam, neardup, packing, pii, quality
from tessera.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_catalog():
    names = list(catalog.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(catalog.oracle_sql()) <= set(names)


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    labels, benchmark = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    forest = quality.train(docs, labels)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality rules", "near-duplicate removal", "benchmark decontamination", "personal data", "best-fit packing"]

    one = stage["quality rules"](spark, docs, SF)
    s = quality.statistics(list(seen.values()))
    kept = {i for i, ok in zip(seen, quality.verdicts(s, forest)[1], strict=True) if ok}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == kept

    two = stage["near-duplicate removal"](spark, one, SF)
    classes = {r.doc_id: r.class_id for r in neardup.report(one).collect()}
    assert two.columns == columns and {r.doc_id for r in two.collect()} == set(classes.values())

    three = stage["benchmark decontamination"](spark, two, SF)
    bad = {r.doc_id for r in decontam.report(two, benchmark).filter("n_hit > 0").collect()}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == set(classes.values()) - bad

    four = stage["personal data"](spark, three, SF)
    left = {r.doc_id: r.text for r in four.collect()}
    assert four.columns == columns and set(left) == set(classes.values()) - bad
    again = pii.report(four, pii.train(three)).selectExpr("sum(n_email + n_ip + n_card + n_phone)").first()[0]
    assert again == 0

    five = stage["best-fit packing"](spark, four, SF).collect()
    assert {r.doc_id for r in five} == set(left)
    rooms = {}
    for r in five:
        rooms[r.sequence_id] = rooms.get(r.sequence_id, 0) + r.length
    assert max(rooms.values()) <= packing.CAPACITY
    whole = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == set(left)


NAMES = ["row", "doc", "digest", "keys", "bag", "size", "node", "rep", "label", "mine", "other", "key", "band", "spans", "more", "base0", "_null", "_n", "_part", "_cell", "a", "b"]


def through(spark, docs):
    """What each stage but the last leaves of docs, and the last one's rows."""
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test")
        left.append(docs)
    return left, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_planted_cases_and_columns_with_any_names(spark, frame):
    """Affected documents go, whatever their length; copies go but for one; clean ones stay with all their columns."""
    prose = [r.text for r in table(spark, SF, "documents").join(table(spark, SF, "labels").filter("quality = 1 and toxic = 0"), "doc_id").orderBy("doc_id").collect()]
    item = max((r.text for r in table(spark, SF, "benchmark").collect()), key=len)
    passage = " ".join(item.split()[:30])
    forest = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    good = [t for t, ok in zip(prose, quality.verdicts(quality.statistics(prose), forest)[1], strict=True) if ok][:30]
    long = " ".join(f"{a} {b}" for a, b in zip(good[:12], good[12:24], strict=True))
    texts = {100 + i: t for i, t in enumerate(good)} | {1: f"{long} {passage} {long}", 2: good[0], 3: good[0] + " more", 4: None, 5: "", 6: "x"}
    docs = frame(list(texts.items()))
    for n in NAMES:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    left, packed = through(spark, docs)
    assert all(d.columns == docs.columns for d in left)
    benchmark = table(spark, SF, "benchmark")
    hit = {r.doc_id for r in decontam.report(docs, benchmark).filter("n_hit > 0").collect()}
    kept = [{r.doc_id: r for r in d.collect()} for d in left]
    assert 1 in hit and 1 not in kept[2] and not hit & set(kept[2])
    assert set(kept[2]) == set(kept[1]) - hit and {2, 3, 100} & set(kept[1]) == {2} and not {4, 5, 6} & set(kept[0])
    assert all(r[n] == f"own {n}" for r in kept[3].values() for n in NAMES)
    assert {r.doc_id for r in packed} == set(kept[3])


def test_empty_documents_and_nulls(spark, frame):
    assert through(spark, frame([]))[1] == []
    left, packed = through(spark, frame([(None, None), (None, ""), (1, None)]))
    assert packed == [] and all(d.count() == 0 for d in left)


def test_entry_without_the_subpackage(monkeypatch):
    import sys

    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    left = __spark_entry__.queries()
    assert "pipeline" not in left and not any(n.startswith("op") and n[2].isdigit() for n in left) and "three_way_join" in left
