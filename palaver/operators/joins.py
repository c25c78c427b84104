"""Joins on intervals, order and fallback keys.

Interval joins get an equality key: a side is copied into each bucket of ``bucket`` units that it touches, so Spark plans a hash or
sort-merge join rather than a nested loop, and a pair is kept only in the bucket in which its overlap starts. Bucket width should be
near the usual interval length; intervals of any length are joined correctly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palaver.sources.shared import materialised


def _bucketed(df: DataFrame, start: str, end: str, bucket: int) -> DataFrame:
    first, last = F.floor(F.col(start) / bucket), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / bucket)
    return df.withColumn("__bucket", F.explode(F.sequence(first, last)))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], bucket: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Pairs whose half-open intervals overlap. Columns beside ``by``: ``l_*`` and ``r_*``, overlap_start, overlap_end."""
    mark = lambda df, p: df.select(*by, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in by))
    a, b = _bucketed(mark(left, "l"), f"l_{start}", f"l_{end}", bucket), _bucketed(mark(right, "r"), f"r_{start}", f"r_{end}", bucket)
    s, e = F.greatest(f"l_{start}", f"r_{start}"), F.least(f"l_{end}", f"r_{end}")
    pairs = a.join(b, [*by, "__bucket"]).filter((F.col(f"r_{end}") > F.col(f"l_{start}")) & (F.col(f"r_{start}") < F.col(f"l_{end}")) & (F.col("__bucket") == F.floor(s / bucket)))
    return pairs.withColumn("overlap_start", s).withColumn("overlap_end", e).drop("__bucket")


def containment_join(inner: DataFrame, outer: DataFrame, by: list[str], bucket: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Pairs in which ``inner`` (l_*) lies within ``outer`` (r_*)."""
    return interval_join(inner, outer, by, bucket, start, end).filter((F.col(f"l_{start}") >= F.col(f"r_{start}")) & (F.col(f"l_{end}") <= F.col(f"r_{end}")))


def points_in_intervals(points: DataFrame, intervals: DataFrame, by: list[str], at: str, bucket: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Points with start < at <= end, and the interval's columns."""
    p = points.withColumn("__bucket", F.floor((F.col(at) - 1) / bucket))
    return p.join(_bucketed(intervals, start, end, bucket), [*by, "__bucket"]).filter((F.col(at) > F.col(start)) & (F.col(at) <= F.col(end))).drop("__bucket")


def join_with_fallback(left: DataFrame, right: DataFrame, key: str, fallback: Column, value: str) -> DataFrame:
    """``left`` with ``right``'s value for the key, else for the key derived by ``fallback``; rows with neither go."""
    one = right.select(F.col(key).alias("__k1"), F.col(value).alias("__v1"))
    two = right.select(F.col(key).alias("__k2"), F.col(value).alias("__v2"))
    out = left.join(one, F.col(key) == F.col("__k1"), "left").join(two, fallback == F.col("__k2"), "left")
    return out.withColumn(value, F.coalesce("__v1", "__v2")).filter(F.col(value).isNotNull()).drop("__k1", "__k2", "__v1", "__v2")


def lookup(df: DataFrame, vocabulary: DataFrame, column: str, token: str = "token", index: str = "idx", unknown: str | None = "<unk>", name: str | None = None) -> DataFrame:
    """``df`` with the vocabulary index of ``column``; what the vocabulary lacks gets the index of ``unknown`` (or null). Spark picks the
    join by the vocabulary's size."""
    name = name or f"{column}_idx"
    v = vocabulary.select(F.col(token).alias("__token"), F.col(index).alias(name))
    out = df.join(v, F.col(column) == F.col("__token"), "left").drop("__token")
    if unknown is None:
        return out
    rest = vocabulary.filter(F.col(token) == unknown).agg(F.min(index).alias("__unk"))
    return out.crossJoin(F.broadcast(rest)).withColumn(name, F.coalesce(name, "__unk")).drop("__unk")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, name: str, or_equal: bool = False) -> DataFrame:
    """``left`` with the ``value`` of the last ``right`` row before ``at``: one sort of both sides together, no pairs."""
    columns = left.columns
    both = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(*by, at, F.col(value).alias("__v")).withColumn("__side", F.lit(0 if or_equal else 2)), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(name, F.last("__v", ignorenulls=True).over(w)).filter("__side = 1").select(*columns, name)


#: Values whose sums are kept as decimals of 18 places, and so exactly whatever is added and taken away; others are summed interval by interval.
LEAST, MOST = 1e-6, 1e9


def _upto(points: DataFrame, places: DataFrame, by: list[str], at: str, value: str, bucket: int) -> DataFrame:
    """``places(by, at)`` with __n, __sum and __rest: how many points lie at or before each place, the sum of their values, and how many of them are left out of it. Points of a place are one row; sums run within
    buckets, and the sums of the buckets before are added to them."""
    size = F.abs(F.col(value).cast("double"))
    rest = F.isnan(size) | (size >= MOST) | ((size > 0) & (size < LEAST))
    decimal = F.when(~rest, F.col(value)).otherwise(0).cast("decimal(27,18)")
    here = points.filter(F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(*by, at).agg(F.count(F.lit(1)).alias("__n"), F.sum(decimal).alias("__sum"), F.sum(rest.cast("long")).alias("__rest"), F.lit(False).alias("__asked"))
    asked = places.select(*by, at, F.lit(0).cast("long").alias("__n"), F.lit(0).cast("decimal(37,18)").alias("__sum"), F.lit(0).cast("long").alias("__rest"), F.lit(True).alias("__asked"))
    steps = here.unionByName(asked).withColumn("__bucket", F.floor(F.col(at) / bucket))
    sums = ["__n", "__sum", "__rest"]
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = steps.groupBy(*by, "__bucket").agg(*(F.sum(c).alias(c) for c in sums)).select(*by, "__bucket", *(F.sum(c).over(earlier).alias(f"{c}_before") for c in sums))
    within = Window.partitionBy(*by, "__bucket").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    running = steps.select(*by, "__bucket", at, "__asked", *(F.sum(c).over(within).alias(c) for c in sums)).filter("__asked")
    return running.join(buckets, [*by, "__bucket"]).select(*by, at, *((F.col(c) + F.coalesce(f"{c}_before", F.lit(0))).alias(c) for c in sums))


def mean_over(points: DataFrame, intervals: DataFrame, by: list[str], key: list[str], at: str, value: str, bucket: int) -> DataFrame:
    """``key`` (which holds ``by``), the mean of the points' values over the intervals of each key, and n_points; keys without points are kept, null values do not count.

    No point meets an interval: an interval's sum is the difference of two running sums, which are worked out once for each place where intervals start or end. Values that decimals do not hold are
    added to the distinct intervals that they lie in.
    """
    ends = F.explode(F.array("start_ms", "end_ms")).alias(at)
    proper = intervals.filter("start_ms < end_ms")
    upto = materialised(_upto(points, proper.select(*by, ends).distinct(), by, at, value, bucket), "sums")
    # a place between points holds what the place before it does
    side = lambda c, name: upto.select(*by, F.col(at).alias(c), *(F.col(x).alias(f"{x}_{name}") for x in ("__n", "__sum", "__rest")))
    span = [*by, "start_ms", "end_ms"]
    distinct = proper.select(*span).distinct().join(side("start_ms", "s"), [*by, "start_ms"]).join(side("end_ms", "e"), [*by, "end_ms"])
    found = materialised(distinct.select(*span, *((F.col(f"{x}_e") - F.col(f"{x}_s")).alias(x) for x in ("__n", "__sum", "__rest"))).filter("__n > 0"), "spans")
    size = F.abs(F.col(value).cast("double"))
    odd = points.filter(F.isnan(size) | (size >= MOST) | ((size > 0) & (size < LEAST))).select(*by, at, F.col(value).cast("double").alias("__odd"))
    rest = points_in_intervals(odd, found.filter("__rest > 0").select(*span), by, at, bucket).groupBy(*span).agg(F.sum("__odd").alias("__odd"))
    whole = found.join(rest, span, "left").select(*span, "__n", (F.col("__sum").cast("double") + F.coalesce("__odd", F.lit(0.0))).alias("__sum"))
    sums = intervals.select(*key, "start_ms", "end_ms").join(whole, span, "left").groupBy(*key).agg(F.sum("__sum").alias("__sum"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n_points"))
    return sums.select(*key, F.try_divide("__sum", "n_points").alias(f"mean_{value}"), "n_points")


def encode_rows(df: DataFrame, words: DataFrame, pos: DataFrame, tags: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df(word, pos_tag, tag)`` as vocabulary indices, with the previous word's index (-1 at the start). Unknown words and POS tags get their
    ``<unk>``; an unknown tag is an error, for a label that is not in the scheme cannot be learned."""
    out = lookup(lookup(df, words, "word"), pos, "pos_tag")
    out = lookup(out, tags, "tag", unknown=None)
    known = F.when(F.col("tag_idx").isNull(), F.raise_error(F.concat(F.lit("tag not in the scheme: "), F.col("tag")))).otherwise(F.col("tag_idx"))
    return out.withColumn("tag_idx", known).withColumn("previous_word_idx", F.lag("word_idx", 1, -1).over(Window.partitionBy(*by).orderBy(*order)))


def matrix_faults(df: DataFrame, limits: dict[str, int], width: str | None = None, expected_width: int | None = None) -> DataFrame:
    """How many rows have an index outside its vocabulary (``limits``: column -> vocabulary size) or a feature array of the wrong length."""
    outside = lambda c, n: F.coalesce((F.col(c) < 0) | (F.col(c) >= n), F.lit(True))
    sums = [F.sum(outside(c, n).cast("long")).alias(f"bad_{c}") for c, n in limits.items()]
    if width:
        sums.append(F.sum((F.coalesce(F.size(width), F.lit(-1)) != expected_width).cast("long")).alias(f"bad_{width}"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *sums)


def encode_log(log: DataFrame, words: DataFrame, by: list[str], update: str, order: str) -> DataFrame:
    """An update log with word_idx, and previous_word_idx (-1 at the start) within each update."""
    out = lookup(log, words, "word")
    return out.withColumn("previous_word_idx", F.lag("word_idx", 1, -1).over(Window.partitionBy(*by, update).orderBy(order)))
