"""Longest-processing-time scheduling of groups that must stay together into shards of near-equal bytes.

Groups (equal texts) are placed largest first, each into the least-loaded shard. Groups of one size are
interchangeable, so the schedule needs only how many groups there are of each size: the driver sees that histogram
(at most about sqrt(2 * total bytes) sizes, whatever the number of documents) and returns how many groups of each size
go to each shard; ranks within a size, made without gaps on the executors, pick the groups.

Cases: a null text counts as the empty one (size 1, in the same group); repeated rows are rows of their own; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import numbered, stored, table, text_or_empty

SHARDS = 8


def lpt(sizes: list[tuple[int, int]], shards: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """sizes: (size, number of groups). How many groups of each size go to each shard, and the shards' loads.

    A heap of (load, shard) gives the least-loaded shard. Once all loads lie within one size of each other, the heap
    would hand out that size in turns; whole turns are then handed out at once, which changes nothing in the outcome.
    """
    heap = [(0, i) for i in range(shards)]
    out = []
    for size, left in sorted(sizes, reverse=True):
        given = [0] * shards
        while left:
            if left >= shards and max(heap)[0] - heap[0][0] <= size:
                turns, left = divmod(left, shards)
                given = [n + turns for n in given]
                heap = [(load + turns * size, i) for load, i in heap]
                continue
            if len(heap) > 1:
                second = min(heap[1:3])
                load, i = heap[0]
                run = min(left, max(1, (second[0] - load + size - 1) // size))
                heapq.heapreplace(heap, (load + run * size, i))
            else:
                run, i = left, 0
                heap = [(heap[0][0] + run * size, 0)]
            given[i] += run
            left -= run
        out.append((size, given))
    loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
    return out, loads


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row of docs in a shard, equal texts together, slots gapless from 0."""
    spark = docs.sparkSession
    text = text_or_empty()
    rows = stored(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("grp")), "shard-rows")
    groups = stored(rows.groupBy("grp").agg(F.sum("size").alias("group_size")), "shard-groups")
    histogram = [(r[0], r[1]) for r in groups.groupBy("group_size").count().toLocalIterator()]
    plan, _ = lpt(histogram, shards)
    cuts = []
    for size, given in plan:
        ends, at = [], 0
        for n in given:
            at += n
            ends.append(at)
        cuts.append((size, ends))
    schema = T.StructType([T.StructField("group_size", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    ranked = numbered(groups, ["group_size"], ["grp"], "rank")
    placed = ranked.join(spark.createDataFrame(cuts, schema), "group_size").select("grp", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    dealt = stored(rows.join(placed, "grp").select("doc_id", "size", "text_crc32", "shard"), "shard-dealt")
    return numbered(dealt, ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
