"""Operator 7: mixing sources to target weights by Pareto order sampling.

Targets: every source gets its weight's share of all words, but no more than ``cap`` times its own words; what a capped
source cannot take is shared again by weight until none is above its cap.

Inclusion odds: a document's expected copies fall with its size, as size ** -``TILT`` by octaves of size, scaled so that a source's expected words are its
target; none is expected more than ``cap`` times. So a source that is repeated repeats many short documents rather than few long ones, and one that is
cut down keeps more of its documents.

Sample: the whole part of the expected copies is taken for certain, and the rest f is the probability of one more. Documents are ranked by their random
odds divided by their inclusion odds, (u / (1 - u)) / (f / (1 - f)), and taken in that order while they fit into the source's words that are left: the sample's
size is fixed in words. The first document that does not fit ends the run; of the next ``TOP_UP`` in rank, those are added that
still fit, and one that does not if the source comes nearer to its target with it.

Ranking is no sort in one task: keys are sorted by ranges of (source, key), the word sums of the ranges tell where each begins, and a running sum within a range says
which documents are in. Rows that are equal in doc_id, source, size and text are one unit n times over, so ties never pile up.

Defined results: null and empty texts have size 0 and are not taken (0 copies, 0 words); very long texts are counted whole; a source of size 0 has target 0; null sources
are one source, ranked last; rows that repeat a doc_id each count, and of fully equal rows some may be taken once more than others;
null doc_ids are carried through and draw by their texts; ties in rank go by doc_id, then text; an empty table gives no row. Only doc_id, text and source are read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, read_table, unit_interval

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
TILT = 0.25
TOP_UP = 1_000
SEED = 7

WORDS = r"[^\x20\x09-\x0D]+"
#: Sums of doubles may miss a whole number by this much.
SLACK = 1e-9


def _numbered_sources(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``place``, the source's rank by code point from 0, null last: ranks within ranges plus the ranges' offsets."""
    by_name = [F.col("source").isNull(), F.col("source")]
    dealt = materialise(sizes.repartitionByRange(*by_name).withColumn("__part", F.spark_partition_id()))
    ranks = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*by_name)))
    offsets, total = {}, 0
    for part, n in sorted(tuple(r) for r in dealt.groupBy("__part").agg(F.count(F.lit(1))).collect()):
        offsets[part], total = total, total + n
    if not offsets:
        return sizes.withColumn("place", F.lit(0).cast("long"))
    before = F.element_at(F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair)), F.col("__part"))
    return ranks.withColumn("place", (before + F.col("__rank") - 1).cast("long")).drop("__part", "__rank")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes(source, source_size) -> also weight and target. The level is found by sharing the excess again, an aggregate a round."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    weighted = materialise(_numbered_sources(sizes).withColumn("weight", weight).withColumn("__limit", F.lit(cap) * F.col("source_size")))
    total, every = weighted.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level, capped = (total / every if every else 0.0), -1
    while True:
        is_capped = F.col("__limit") < F.lit(level) * F.col("weight")
        n, full, left = weighted.agg(F.count(F.when(is_capped, 1)), F.coalesce(F.sum(F.when(is_capped, F.col("__limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~is_capped, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not left:
            break
        level, capped = (total - full) / left, n
    return weighted.withColumn("target", F.least(F.col("__limit"), F.lit(level) * F.col("weight"))).drop("__limit", "place")


def expected_copies(classes: DataFrame, cap: float = CAP, tilt: float = TILT) -> DataFrame:
    """classes(source, octave, words, source_size, target) -> also copies and part, the whole and the rest of the expected copies of an octave's documents.

    Short documents reach the cap first: with the octaves before one at the cap, the scale for the others follows from sums; it holds from the first octave on that is
    not above the cap with it. At most 64 octaves a source.
    """
    factor = F.pow(F.lit(2.0), -F.lit(tilt) * F.col("octave"))
    along = Window.partitionBy("source").orderBy("octave")
    before = F.coalesce(F.sum("words").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(cap)
    after = F.sum(factor * F.col("words")).over(along.rowsBetween(0, Window.unboundedFollowing))
    scale = F.try_divide(F.greatest(F.col("target") - before, F.lit(0.0)), after)
    holds = scale * factor <= F.lit(cap + SLACK)
    found = classes.withColumn("__scale", F.when(holds, scale)).withColumn("__scale", F.first("__scale", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    copies = F.least(F.lit(cap), F.coalesce(F.col("__scale") * factor, F.lit(cap)))
    whole = F.floor(copies + F.lit(SLACK))
    return found.withColumn("copies", whole.cast("long")).withColumn("part", F.greatest(F.lit(0.0), copies - whole)).drop("__scale")


def _top_up(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the documents behind the cut, in rank order, those that still fit, and the smallest other one if with it the words end nearer
    to the target than without. One source; at most TOP_UP rows."""
    rows = rows.sort_values("nth").reset_index(drop=True)
    left, extra = float(rows["room"].iloc[0]), []
    for size in rows["size"]:
        extra.append(int(size <= left))
        left -= size * extra[-1]
    rows["extra"] = extra
    passed = rows[rows["extra"] == 0].sort_values(["size", "nth"])
    if len(passed) and passed["size"].iloc[0] < 2 * left:
        rows.loc[passed.index[0], "extra"] = 1
    return rows[["unit", "extra"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, tilt: float = TILT, seed: int = SEED, row: str | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: doc_id, size, source_size, target, copies (whole copies taken). ``row``, the name of
    a long column that numbers the rows, comes first if it is given; equal rows are then units of their own."""
    own = F.col(row) if row else F.lit(None)
    thin = docs.select(own.cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text"))
    units = materialise(thin.groupBy("row", "doc_id", "source", "size", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("octave", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")))).otherwise(0).cast("int")).withColumn("unit", F.monotonically_increasing_id()))
    octaves = units.groupBy("source", "octave").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    octaves = materialise(octaves)
    sizes = octaves.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, cap))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    planned = materialise(expected_copies(octaves.join(targets, same(octaves, targets)).drop(targets["source"]), cap, tilt))
    plan = planned.select(F.col("source").alias("__of"), F.col("octave").alias("__octave"), "source_size", "target", "copies", "part")
    each = units.join(plan, units["source"].eqNullSafe(plan["__of"]) & (units["octave"] == plan["__octave"])).drop("__of", "__octave")
    each = each.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0))
    # of n equal rows, n * part are due for one copy more: the whole part of that for certain, the rest is drawn for
    each = each.withColumn("due", F.when(F.col("size") > 0, F.col("n") * F.col("part")).otherwise(0.0)).withColumn("sure", F.floor(F.col("due") + F.lit(SLACK)).cast("long")).withColumn("odds", F.greatest(F.lit(0.0), F.col("due") - F.col("sure")))
    each = materialise(each)
    certain = each.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * (F.col("copies") * F.col("n") + F.col("sure"))).alias("words"))
    room = certain.select(F.col("source").alias("__of"), (F.col("target") - F.col("words")).alias("room"))
    u = unit_interval(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("text"))
    rank_key = (u / (1 - u)) / (F.col("odds") / (1 - F.col("odds")))
    order = ["rank_key", F.col("doc_id").asc_nulls_last(), "text", "unit"]
    ranked = each.filter(F.col("odds") > SLACK).select("unit", "source", "size", "doc_id", "text", rank_key.alias("rank_key"))
    ranked = materialise(ranked.repartitionByRange(F.col("source"), *order).withColumn("range", F.spark_partition_id()))
    ranges = ranked.groupBy("source", "range").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(F.col("source").alias("__source"), F.col("range").alias("__range"), *(F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"{c}_before") for c in ("words", "rows")))
    within = Window.partitionBy("source", "range").orderBy(*order)
    running = ranked.withColumn("upto", F.sum("size").over(within)).withColumn("nth", F.row_number().over(within))
    running = running.join(offsets, running["source"].eqNullSafe(offsets["__source"]) & (running["range"] == offsets["__range"])).join(room, running["source"].eqNullSafe(room["__of"]))
    running = running.select("unit", "source", "size", (F.col("upto") + F.col("words_before")).alias("upto"), (F.col("nth") + F.col("rows_before")).alias("nth"), "room")
    running = materialise(running)
    fits = F.col("upto") <= F.col("room") + F.lit(SLACK)
    taken = running.filter(fits).groupBy("source").agg(F.max("upto").alias("used"), F.max("nth").alias("last"))
    behind = running.filter(~fits).join(taken.select(F.col("source").alias("__taken"), "used", "last"), running["source"].eqNullSafe(F.col("__taken")), "left")
    behind = behind.withColumn("nth", F.col("nth") - F.coalesce("last", F.lit(0))).withColumn("room", F.col("room") + F.lit(SLACK) - F.coalesce("used", F.lit(0)))
    behind = behind.filter(F.col("nth") <= TOP_UP)
    topped = behind.select("unit", "source", "size", "nth", "room").groupBy("source").applyInPandas(_top_up, "unit long, extra long")
    extras = running.filter(fits).select("unit", F.lit(1).cast("long").alias("extra")).unionByName(topped.filter("extra > 0"))
    decided = each.join(extras, "unit", "left").withColumn("more", F.col("sure") + F.coalesce("extra", F.lit(0)))
    spread = decided.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    out = spread.select(*([F.col("row").alias(row)] if row else []), "doc_id", "size", "source_size", "target", (F.col("copies") + (F.col("nth") <= F.col("more")).cast("long")).alias("copies"))
    return out


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(mix(read_table(spark, sf_dir, "documents", "doc_id", "text", "source")))
