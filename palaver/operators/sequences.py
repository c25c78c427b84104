"""Ordered operators over words: context windows, islands, time repair, merging and numbering.

``order`` columns must be a total order within ``by``. Nearly all of them are window functions on one partitioning, so chained
operators on the same keys need one shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palaver.sources.shared import materialised


def context_backwards(value: str, by: list[str], order: list[str], width: int, pad: int = -1) -> Column:
    """The last ``width`` values up to and with the row, left-padded."""
    w = Window.partitionBy(*by).orderBy(*order)
    return F.array(*(F.lag(value, k, pad).over(w) for k in range(width - 1, -1, -1)))


def context_symmetric(value: str, by: list[str], order: list[str], width: int, pad: int = -1) -> Column:
    """``width`` (odd) values around the row, padded at both ends."""
    w, half = Window.partitionBy(*by).orderBy(*order), width // 2
    return F.array(*(F.lag(value, k, pad).over(w) for k in range(half, 0, -1)), F.col(value), *(F.lead(value, k, pad).over(w) for k in range(1, half + 1)))


def bptt_range(i: Column, steps: int) -> tuple[Column, Column]:
    """(start, stop) of the rows that step ``i`` (from 0) is trained through: growing to ``steps`` rows, then sliding."""
    return F.greatest(F.lit(0), i - steps + 1), i


def last_n(value: str, by: list[str], order: list[str], n: int) -> Column:
    """The last ``n`` values up to and with the row; fewer at the start."""
    return F.collect_list(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0))


def timing_lags(start: str, by: list[str], order: list[str]) -> tuple[Column, Column, Column]:
    """Time since the previous word's start, and that value one and two words earlier (0 where there is none)."""
    w = Window.partitionBy(*by).orderBy(*order)
    delta = lambda k: F.coalesce(F.lag(start, k).over(w) - F.lag(start, k + 1).over(w), F.lit(0)) if k else F.coalesce(F.col(start) - F.lag(start, 1).over(w), F.lit(0))
    return delta(0), delta(1), delta(2)


def islands(df: DataFrame, by: list[str], order: list[str], inside: Column, name: str = "island") -> DataFrame:
    """The rows of maximal runs where ``inside`` holds, numbered from 0 within ``by``."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__in", inside).withColumn("__begin", F.when(F.col("__in") & ~F.coalesce(F.lag("__in").over(w), F.lit(False)), 1).otherwise(0))
    return marked.withColumn(name, (F.sum("__begin").over(w) - 1).cast("long")).filter("__in").drop("__in", "__begin")


def forward_fill(value: str, by: list[str], order: list[str]) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def spread_equal_times(df: DataFrame, by: list[str], order: list[str], start: str = "start_ms", end: str = "end_ms", tail_ms: int = 300) -> DataFrame:
    """Words of zero length share the time up to the next word's end: a run of zero-length words and the word that follows it split that
    word's interval evenly. A run at the end, which nothing follows, gets ``tail_ms`` for each word."""
    line = Window.partitionBy(*by).orderBy(*order)
    zero = F.col(end) <= F.col(start)
    no = F.lit(False)
    marked = df.withColumn("__begins", F.row_number().over(line) == 1).withColumn("__solid", F.coalesce(~zero, no)).withColumn("__zero", F.coalesce(zero, no))
    schema = T.StructType([T.StructField(f.name, T.LongType()) if f.name in (start, end) else f for f in df.schema])
    # the window has sorted the rows already; they are read as a stream, and only the run that is not over yet is kept
    return marked.sortWithinPartitions(*by, *order).mapInArrow(lambda batches: _spread_runs(batches, start, end, tail_ms), schema)


def _spread_runs(batches, start: str, end: str, tail_ms: int):
    waiting = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows]).combine_chunks()
        solid, begins = (rows[c].to_numpy() for c in ("__solid", "__begins"))
        # the last run may go on in the next batch, unless a word with a length has ended it
        last = np.flatnonzero(begins | np.r_[False, solid[:-1]])
        over = len(rows) if not len(rows) or solid[-1] else int(last[-1]) if len(last) else 0
        waiting = rows.slice(over) if over < len(rows) else None
        if over:
            yield from _spread(rows.slice(0, over), start, end, tail_ms)
    if waiting is not None:
        yield from _spread(waiting, start, end, tail_ms)


def _spread(rows: pa.Table, start: str, end: str, tail_ms: int):
    """Batches of whole runs with their times shared out."""
    solid, begins, zero = (rows[c].to_numpy() for c in ("__solid", "__begins", "__zero"))
    firsts = np.flatnonzero(begins | np.r_[True, solid[:-1]])
    n = np.diff(np.r_[firsts, len(rows)])
    run = np.repeat(np.arange(len(firsts)), n)
    k = np.arange(len(rows)) - firsts[run]
    missing = [pc.is_null(rows[c]).to_numpy() for c in (start, end)]
    s, e = (pc.fill_null(rows[c], 0).to_numpy() for c in (start, end))
    most = np.iinfo(np.int64).max if s.dtype.kind == "i" else np.inf
    first = np.minimum.reduceat(np.where(missing[0], most, s), firsts)[run]
    until = np.maximum.reduceat(np.where(missing[1], -most, e), firsts)[run]
    none = (np.logical_and.reduceat(missing[0], firsts) | np.logical_and.reduceat(missing[1], firsts))[run]
    tail = (np.logical_or.reduceat(zero, firsts) & ~np.logical_or.reduceat(solid, firsts))[run]
    first, until = np.where(none, 0, first), np.where(none, 0, until)
    at = lambda j: pa.array(np.where(tail, first + j * tail_ms, first + np.floor(j * (until - first) / n[run]).astype(first.dtype)).astype(np.int64), mask=none)
    new = {start: at(k), end: at(k + 1)}
    names = [c for c in rows.column_names if c not in ("__solid", "__begins", "__zero")]
    yield from pa.table({c: new.get(c, rows[c]) for c in names}).to_batches()


def merge_continuations(df: DataFrame, by: list[str], order: list[str], continues: Column, name: str = "merged") -> DataFrame:
    """Numbers units so that a row where ``continues`` holds belongs to the one before it."""
    w = Window.partitionBy(*by).orderBy(*order)
    begin = F.when(continues & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__begin", begin).withColumn(name, (F.sum("__begin").over(w) - 1).cast("long")).drop("__begin")


def floor_tags(by: list[str], order: list[str], speaker: str = "speaker") -> Column:
    """``take`` where another speaker had the turn before, else ``keep``; the first turn takes."""
    before = F.lag(speaker).over(Window.partitionBy(*by).orderBy(*order))
    return F.when(before.isNull() | (before != F.col(speaker)), "take").otherwise("keep")


def neighbour(value: str, by: list[str], order: list[str], k: int = 1) -> Column:
    """The value ``k`` rows later (earlier for negative ``k``) of the same group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return F.lead(value, k).over(w) if k >= 0 else F.lag(value, -k).over(w)


def folds(df: DataFrame, unit: str, n_folds: int) -> DataFrame:
    """Contiguous folds over the distinct values of ``unit``. The values are one column of one table, numbered by rank ranges: a
    range partitioning gives each value its global rank without sorting in one task."""
    values = df.select(unit).distinct()
    total = values.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("__total"))
    numbered = with_rank(values, unit).crossJoin(F.broadcast(total)).withColumn("fold", F.floor(F.col("rank") * n_folds / F.col("__total")).cast("int")).drop("rank", "__total")
    return df.join(numbered, unit)


def running_total(values: DataFrame, column: str, weight: str, name: str) -> DataFrame:
    """``values`` with the sum of ``weight`` over the rows before by ``column`` (distinct values): sums within range partitions plus the sums of the partitions before. The
    partitions are written with their numbers: planned twice they would be cut at other samples, and merged otherwise, for the sums than for the rows."""
    parts = materialised(values.repartitionByRange(column).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("__part").agg(F.sum(weight).alias("__sum"))
    before = sums.withColumn("__before_part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before_part")
    within = Window.partitionBy("__part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumn("__inside", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return inside.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before_part") + F.col("__inside")).cast("long")).drop("__part", "__before_part", "__inside")


def with_rank(values: DataFrame, column: str) -> DataFrame:
    """Global rank from 0 of the rows by ``column`` (distinct values)."""
    return running_total(values.withColumn("__one", F.lit(1)), column, "__one", "rank").drop("__one")


def fold_roles(fold: Column, n_folds: int, round_no: int) -> Column:
    """Role of a fold in a round of rotation: one test fold, the next one held out, the rest for training."""
    return F.when(fold == round_no % n_folds, "test").when(fold == (round_no + 1) % n_folds, "heldout").otherwise("train")


def distinct_within(df: DataFrame, by: list[str], order: list[str], fields: list[str], reach: int = 10) -> DataFrame:
    """Without rows whose ``fields`` equal those of one of the ``reach`` rows before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-reach, -1)
    key = F.struct(*fields)
    return df.withColumn("__seen", F.array_contains(F.collect_list(key).over(w), key)).filter("not __seen").drop("__seen")


def prefix_counts(lines: DataFrame, column: str = "line") -> DataFrame:
    """prefix (blank-joined) and n_prefixes, how many of the token arrays begin with it. What is shuffled for a prefix is 128 bits of SHA-256, chained token by token, and a place where it stands; its text is cut out
    there once it is counted."""
    whole = materialised(lines.filter(F.size(column) > 0).groupBy(F.col(column).alias("line")).agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), "lines")
    # between two tokens stands the digest of what is before them, which is of one length
    step = lambda done, t: F.substring(F.sha2(F.concat(done, t), 256), 1, 32)
    chain = F.aggregate("line", F.array(F.lit("0" * 32)), lambda done, t: F.concat(done, F.array(step(F.element_at(done, -1), t))))
    each = whole.select("id", "n", F.posexplode(chain).alias("k", "digest")).filter("k > 0")
    counted = each.groupBy(F.unhex("digest").alias("digest")).agg(F.sum("n").alias("n"), F.min("id").alias("id"), F.min("k").alias("k"))
    cuts = counted.groupBy("id").agg(F.collect_list(F.struct("k", "n")).alias("cuts"))
    found = whole.select("id", "line").join(cuts, "id").select("line", F.explode("cuts").alias("c"))
    return found.select(F.concat_ws(" ", F.slice("line", 1, F.col("c.k"))).alias("prefix"), F.col("c.n").alias("n_prefixes"))


def seeded_order(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """``df`` with its rows' place in an order that depends on the seed and the key (distinct values) alone, so columns of one table, or tables of one key, are shuffled alike."""
    mixed = df.withColumn("__mixed", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    return with_rank(mixed, "__mixed").withColumnRenamed("rank", name).drop("__mixed")


def filled_negatives(value: str, by: list[str], order: list[str], group: str) -> Column:
    """``value``, or the mean of what its ``group`` had before (within ``by``; 0 if nothing) where it is negative."""
    before = Window.partitionBy(*by, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.when(F.col(value) < 0, F.coalesce(F.avg(F.when(F.col(value) >= 0, F.col(value))).over(before), F.lit(0.0))).otherwise(F.col(value).cast("double"))
