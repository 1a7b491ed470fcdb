"""What the operators share: reading tables, the shared folder, exact numbering, document slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of the two-level numbering; a cell holds rows / BUCKETS of its key at most, as ids hash evenly.
BUCKETS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a fresh local one only where none is set and all run on one machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tessera.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.tessera.shared.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the application's file systems close."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that no later step reads."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


#: Rows of a narrow table in each of its files.
FILE_ROWS = 200_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation.

    rows: a bound of the number of rows, for narrow tables whose last step is cheap; they go to that many files, not to one a partition.
    """
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // FILE_ROWS)))
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add `name`: 0, 1, 2 ... without gaps within each combination of `keys`.

    Two levels keep a hot key out of a single task: rows are counted per (keys, hash bucket of `order`), the bucket
    counts are summed up in bucket order, and only rows of one cell are sorted together. df must be replayable with the
    same rows (stored or read), as it is scanned twice. Rows that tie in `order` get different numbers in any order.
    """
    cells = [*keys, "_bucket"]
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n")).select(*cells, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*cells).orderBy(*order)) - 1)
    return within.join(offsets, cells).withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_bucket", "_before", "_at")


#: Rows of one key that may meet in a task, and the most keys that are treated as hot.
HOT_ROWS, HOT_KEYS = 1024, 50_000
#: Rows of a narrow table (a few numbers each) that are broadcast at most.
BROADCAST_ROWS = 1 << 19


def counted(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, int]:
    """stored(), and the number of rows that were written."""
    seen = Observation()
    return stored(df.observe(seen, F.count(F.lit(1)).alias("n")), name, rows), int(seen.get["n"])


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", spread: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """many (stored or read) joined with one (narrow, its keys distinct), where a key may have any share of many's rows.

    one is counted: up to BROADCAST_ROWS it is broadcast. Beyond, rows are shuffled and each hot key is dealt into several cells, for
    each of which its row of one is repeated. A key is hot from HOT_ROWS rows on, or from a HOT_KEYS-th of all rows, so that the table of
    hot keys is bounded. spread: columns whose hash deals the rows (default: all). rows: a bound of one's rows. Null keys match nothing.
    """
    one, n_one = counted(one, "join", rows)
    if n_one <= BROADCAST_ROWS:
        return many.join(F.broadcast(one), keys, how)
    least = max(HOT_ROWS, many.count() // HOT_KEYS)
    numbers = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(numbers.filter(F.col("_n") > least).select(*keys, F.ceil(F.col("_n") / least).cast("int").alias("_parts")))
    # rows without a key match nothing and lie anywhere
    none = reduce(or_, (F.col(k).isNull() for k in keys))
    parts = F.when(none, HOT_ROWS).otherwise(F.coalesce("_parts", F.lit(1)))
    dealt = many.join(hot, keys, "left").withColumn("_cell", F.pmod(F.xxhash64(*(spread or many.columns)), parts).cast("int")).drop("_parts")
    copies = one.join(hot, keys, "left").withColumn("_cell", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies.hint("merge"), [*keys, "_cell"], how).drop("_cell")


def attached(wide: DataFrame, narrow: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Wide rows (key distinct) with each of narrow's rows of their key. narrow is counted: up to BROADCAST_ROWS it is broadcast, so that wide
    rows stay where they are."""
    narrow, n = counted(narrow, "ids", rows)
    return wide.join(F.broadcast(narrow) if n <= BROADCAST_ROWS else narrow.hint("merge"), key)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of whole rows of about most_bytes of text, so that working arrays stay small."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = batch.schema.get_field_index(text)
        lengths = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
        begin, size = 0, 0
        for i in range(n):
            size += int(lengths[i])
            if size >= most_bytes:
                yield batch.slice(begin, i + 1 - begin)
                begin, size = i + 1, 0
        if begin < n:
            yield batch.slice(begin, n - begin)


#: Label rows with this remainder of crc32(doc_id as text) mod 4 are held out from every fit.
HELD_OUT = 2


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT


def labelled(labels: DataFrame, column: str, most: int) -> list[tuple[int, int]]:
    """(doc_id, label) of about `most` training labels at most, picked evenly by a hash of doc_id.

    Held-out rows, null ids and null labels are left out; of several labels of one document the greatest counts.
    """
    rows = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).alias(column))
    n = rows.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < most)
    return sorted((r[0], int(r[1])) for r in rows.collect())
