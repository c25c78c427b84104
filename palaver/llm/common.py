"""Shared pieces of the training-data operators: word bytes, Arrow text scans, shared-folder checkpoints, exact top-k."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# ``bytes.lower`` and ``bytes.split`` work on ASCII only, and UTF-8 bytes >= 0x80 never clash with ASCII, so the
# two word classes of the contracts can be cut on UTF-8 bytes without decoding:
#   [^\x00-\x2F\x3A-\x60\x7B-\x7F]+  after lower-casing A-Z  ->  text.translate(ALNUM).split()
#   [^\x20\x09-\x0D]+                                        ->  text.split()
ALNUM = bytes((c | 0x20 if 0x41 <= c <= 0x5A else c) if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder the cluster names. Only a local session (tests) that names none gets one of our own; on a cluster that is an error, for
    its executors would not share the folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "palaver-checkpoints")
    sc.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again. Unlike a checkpoint it does not keep the planner's estimate of its size, a product over all joins before it, which
    in a long chain of joins grows until planning takes longer than the work."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with a worker-side set-up step: ``make()`` runs once per task and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or ``name`` with underscores before it, as no column of ``taken`` is called in any case of letters."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text without decoding; null reads as empty."""
    for value in column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary()):
        yield value.as_py() or b""


#: Bytes of text that are turned into arrays at a time.
PIECE_BYTES = 1 << 20
_CUT = re.compile(rb"[ \t\n\v\f\r]")


def in_pieces(texts_: list[bytes], run: Callable[[list[bytes]], tuple]) -> tuple:
    """What ``run(texts)`` gives for many texts, or parts of very long ones cut at blanks: arrays of a value a word, the last one with the number of the word's text. Only about PIECE_BYTES are
    looked at together, so memory is bounded by the words' values."""
    held, owner, size, out = [], [], 0, []

    def flush() -> None:
        nonlocal held, owner, size
        if held:
            *values, of = run(held)
            out.append((*values, np.array(owner, np.int64)[of]))
        held, owner, size = [], [], 0

    for number, text in enumerate(texts_):
        at = 0
        while at < len(text):
            blank = _CUT.search(text, at + PIECE_BYTES) if len(text) - at > PIECE_BYTES else None
            end = blank.end() if blank else len(text)
            held.append(text[at:end])
            owner.append(number)
            size, at = size + end - at, end
            if size >= PIECE_BYTES:
                flush()
    flush()
    return tuple(np.concatenate(c) for c in zip(*out)) if out else run([])


BLANK = np.array([c in b" \t\n\v\f\r" for c in range(256)])


def words_in(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words end to end, sizes of the words, number of each word's text) of texts."""
    data = np.frombuffer(b" ".join(texts_), np.uint8)
    inside = ~BLANK[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    starts = np.flatnonzero(edge == 1)
    bounds = np.cumsum([len(t) + 1 for t in texts_])
    return data[inside], np.flatnonzero(edge == -1) - starts, np.searchsorted(bounds, starts, side="right")


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def mix_bits(a: np.ndarray) -> np.ndarray:
    a = a ^ (a >> np.uint64(33))
    a = a * _MIX
    return a ^ (a >> np.uint64(29))


def run_hashes(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A polynomial hash of every run of bytes; the runs (of no size 0) lie end to end."""
    if not sizes.size:
        return np.empty(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(int(sizes.max()), _ODD))
    nth = np.arange(letters.size) - np.repeat(first, sizes)
    return mix_bits(np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * powers[nth], first))


def unit_interval(*columns: Column) -> Column:
    """A reproducible uniform draw in the open interval (0, 1) keyed by the given columns."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns), 12).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def top_k(df: DataFrame, key: str, k: int, tie_breakers: list[str], buckets: int = 4096, exact_below: int = 20_000) -> DataFrame:
    """Exactly ``k`` rows with the largest ``key``, found by refining a histogram rather than by one global sort.

    Each pass counts rows in ``buckets`` equal key ranges (a map-side combined aggregate), keeps everything above the
    range in which the k-th row lies and looks again inside it; only that last range is ranked row by row. ``key`` must
    hold no null or NaN; ``df`` should be materialised, for it is scanned once a pass.
    """
    low, high, total = df.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    if k >= (total or 0):
        return df
    if k <= 0:
        return df.limit(0)
    inside = F.lit(True)
    above = F.lit(False)
    need, here = k, total
    while here > exact_below and high > low:
        width = (high - low) / buckets
        if not (width > 0 and low + width > low and high - width < high):
            break
        slot = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(buckets - 1))
        counts = {r[0]: (r[1], r[2], r[3]) for r in df.filter(inside).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)), F.min(key), F.max(key)).collect()}
        for at in sorted(counts, reverse=True):
            n, bottom, top = counts[at]
            if n >= need:
                break
            need -= n
        if n == here and (bottom, top) == (low, high):
            break
        above = above | (inside & (F.col(key) > F.lit(top)))
        inside = (F.col(key) >= F.lit(bottom)) & (F.col(key) <= F.lit(top))
        low, high, here = bottom, top, n
    if here == need:
        return df.filter(above | inside)
    if here <= exact_below:
        order = Window.orderBy(F.col(key).desc(), *tie_breakers)
        last = df.filter(inside).withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= F.lit(need)).drop("__rank")
        return df.filter(above).unionByName(last)
    # very many rows share the last key: every partition gives its share of them, in the order of the partitions
    tied = df.filter(inside).withColumn("__part", F.spark_partition_id())
    shares, left = [], need
    for part, n in sorted(tuple(r) for r in tied.groupBy("__part").agg(F.count(F.lit(1))).collect()):
        shares.append((part, min(n, left)))
        left -= min(n, left)
    share = F.element_at(F.create_map(*(F.lit(x) for pair in shares for x in pair)), F.col("__part"))
    within = Window.partitionBy("__part").orderBy(*tie_breakers)
    last = tied.withColumn("__rank", F.row_number().over(within)).filter(F.col("__rank") <= share).drop("__rank", "__part")
    return df.filter(above).unionByName(last)


#: Keys whose rows are spread over all tasks by ``join_counted``; a thousandth of all rows is a fair share for one task.
HEAVY_KEYS = 1000


def join_counted(rows: DataFrame, counts: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """Inner (or left) join of ``rows`` with ``counts``, one row a key, whose column ``count`` says how many of ``rows`` have the key.

    Keys with over 1/HEAVY_KEYS of all rows, of which there are fewer than HEAVY_KEYS by counting, are broadcast, and their rows stay
    with others of the partition they come from; the rest is joined by key. ``rows`` is read once, ``counts`` (materialised) twice.
    """
    total = counts.agg(F.sum(count)).first()[0] or 0
    others = [c for c in counts.columns if c not in on]
    heavy_name, light_name, salt_name, found_name = (free_name(c, [*rows.columns, *counts.columns]) for c in ("heavy", "light", "salt", "found"))
    is_heavy = F.col(count) * F.lit(HEAVY_KEYS) > F.lit(total)
    heavy = counts.filter(is_heavy).select(*on, F.struct(*others).alias(heavy_name))
    light = counts.filter(~is_heavy).select(*on, F.lit(0).cast("long").alias(salt_name), F.struct(*others).alias(light_name))
    salt = 1 + F.pmod(F.xxhash64(*on, F.spark_partition_id()), F.lit(HEAVY_KEYS))
    marked = rows.join(F.broadcast(heavy), on, "left").withColumn(salt_name, F.when(F.col(heavy_name).isNull(), 0).otherwise(salt).cast("long"))
    joined = marked.join(light, [*on, salt_name], "left").withColumn(found_name, F.coalesce(heavy_name, light_name))
    if how == "inner":
        joined = joined.filter(F.col(found_name).isNotNull())
    return joined.select(*rows.columns, *(F.col(found_name)[c].alias(c) for c in others))


#: Rows of a narrow table that may be broadcast to wide rows; they are counted first. A key and a few numbers each: some 30 MB.
BROADCAST_ROWS = 500_000


def join_narrow(wide: DataFrame, narrow: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """``wide`` joined with ``narrow``, which has the given number of ``rows`` (or as many entries in its arrays): up to BROADCAST_ROWS it goes to the wide rows, beyond that both are shuffled."""
    return wide.join(F.broadcast(narrow) if rows <= BROADCAST_ROWS else narrow, on, how)


def hash_sample(df: DataFrame, columns: list[str], size: int, total: int) -> DataFrame:
    """About ``size`` of the ``total`` rows of ``df``, picked by the hash of ``columns`` (all rows if there are no more): a filter, so no task
    sends more than its share. The number of rows is within a few standard deviations (sqrt(size)) of ``size``."""
    if total <= size:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), *columns), F.lit(1 << 32)) < F.lit(size * (1 << 32) // total))
