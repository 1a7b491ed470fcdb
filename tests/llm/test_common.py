from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import attached, counted, labelled, numbered, shared_dir, slices, spread_join, stored


def test_numbers_are_gapless(spark):
    rows = stored(spark.range(5000).select((F.col("id") % 7).alias("k"), (F.col("id") % 50).alias("x"), "id"), "test")
    held = defaultdict(list)
    for r in numbered(rows, ["k"], ["x"], "n").collect():
        held[r.k].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    assert numbered(rows.limit(0), ["k"], ["x"], "n").count() == 0


def test_slices_keep_rows(frame):
    batches = frame(["x" * 100, "", None, "y" * 50]).toArrow().to_batches()
    cut = list(slices(iter(batches), most_bytes=60))
    assert sum(b.num_rows for b in cut) == 4 and all(b.num_rows for b in cut)


def test_labels(spark):
    data = [(i, 1, i % 2) for i in range(400)] + [(4, 1, 1), (None, 1, 1), (8, 1, None)]
    labels = spark.createDataFrame(data, "doc_id long, quality int, toxic int")
    import zlib

    told = labelled(labels, "toxic", 10_000)
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in told) and len(told) == len({i for i, _ in told})
    assert 0 < len(labelled(labels, "toxic", 50)) < 120


def test_shared_dir_is_kept(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_hot_keys_are_dealt(spark, monkeypatch):
    many = stored(spark.range(9000).select(F.when(F.col("id") < 5000, 0).when(F.col("id") < 8000, F.col("id") % 50).alias("k"), "id"), "test")
    one = spark.createDataFrame([(k, f"v{k}") for k in range(40)] + [(None, "n")], "k long, v string")
    for most in (common.BROADCAST_ROWS, 3):  # broadcast; shuffled
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        for how in ("inner", "left"):
            want, got = many.join(one, "k", how), spread_join(many, one, ["k"], how, spread=["id"])
            assert sorted(map(str, got.select("k", "id", "v").collect())) == sorted(map(str, want.select("k", "id", "v").collect()))
        assert spread_join(many.limit(0), one, ["k"]).collect() == []


def test_attached_rows(spark, monkeypatch):
    rows, ids = spark.range(100).withColumn("x", F.lit("y")), spark.range(0, 200, 7)
    for most in (common.BROADCAST_ROWS, 3):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        assert sorted(r.id for r in attached(rows, ids, "id").collect()) == list(range(0, 100, 7))
        assert counted(ids, "test")[1] == 29
