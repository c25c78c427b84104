"""A folder of revocable tag rows that survives restarts.

Each micro-batch is written to a folder of its own, named by its batch id. Spark repeats a batch that it did not see committed, with the same id and rows, so a repeated batch replaces its folder and no row is there twice. Every so many
batches what still stands is written anew: rows that a later version has replaced or revoked are left out, and readers take the newest complete compaction and the batches behind it. Folders that two compactions have made needless go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from .tagger import OUTPUT, final_view

BATCHES, COMPACTED = "batches", "compacted"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete folders below ``path``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [s.getPath() for s in files.listStatus(root)]
    return sorted(int(p.getName()) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def without_superseded(rows: DataFrame) -> DataFrame:
    """``rows`` without those that can never stand again: all but the last version of each part, the highest version of each position below that one's length, and faults."""
    part = Window.partitionBy("key", "part")
    position = Window.partitionBy("key", "part", "idx")
    good = rows.filter("fault is null").withColumn("__last", F.max(F.struct("version", "length")).over(part)).withColumn("__top", F.max("version").over(position))
    kept = good.filter((F.col("version") == F.col("__last.version")) | ((F.col("version") == F.col("__top")) & (F.col("idx") < F.col("__last.length"))))
    return kept.drop("__last", "__top").unionByName(rows.filter("fault is not null"))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The newest compaction and all complete batches behind it."""
    compacted = _numbers(spark, f"{path}/{COMPACTED}")
    upto = compacted[-1] if compacted else -1
    folders = [f"{path}/{COMPACTED}/{n}" for n in compacted[-1:]] + [f"{path}/{BATCHES}/{n}" for n in _numbers(spark, f"{path}/{BATCHES}") if n > upto]
    return reduce(DataFrame.unionByName, [spark.read.schema(OUTPUT).parquet(f) for f in folders]) if folders else spark.createDataFrame([], OUTPUT)


def read_standing(spark: SparkSession, path: str) -> DataFrame:
    """The tags that stand: key, part, idx, word, tag."""
    return final_view(read_rows(spark, path))


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Writes what stands after batch ``upto``. Done again, it writes the same rows."""
    before = [n for n in _numbers(spark, f"{path}/{COMPACTED}") if n < upto]
    base = [f"{path}/{COMPACTED}/{n}" for n in before[-1:]]
    since = [n for n in _numbers(spark, f"{path}/{BATCHES}") if (before[-1] if before else -1) < n <= upto]
    rows = [spark.read.schema(OUTPUT).parquet(f) for f in base + [f"{path}/{BATCHES}/{n}" for n in since]]
    if rows:
        without_superseded(reduce(DataFrame.unionByName, rows)).write.mode("overwrite").parquet(f"{path}/{COMPACTED}/{upto}")
    if before:  # a reader may still be at the compaction before this one, not at what that one replaced
        for n in before[:-1]:
            _drop(spark, f"{path}/{COMPACTED}/{n}")
        for n in _numbers(spark, f"{path}/{BATCHES}"):
            if n <= before[-1]:
                _drop(spark, f"{path}/{BATCHES}/{n}")


def write_rows(rows: DataFrame, path: str, checkpoint: str, every: int = 20) -> DataStreamWriter:
    """A writer of a stream of tag rows (``tagger.tag_stream`` or ``reordering.tag_stream_in_order``) to ``path``; ``every`` so many batches it compacts. The caller sets the trigger and starts it."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCHES}/{number}")
        if (number + 1) % every == 0:
            compact(batch.sparkSession, path, number)

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
