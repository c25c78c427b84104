"""Repairs from bracket markup: ``[ reparandum + {F uh, } repair ]``, nested, and across the turns of a speaker.

A turn's text is split at blanks into marks and words. ``[`` opens a repair, ``+`` is its point of interruption, ``]`` closes the innermost open one; ``{X`` and ``}`` enclose edit terms (``{C``, a conjunction, does not).

No turn and no conversation is parsed in one place. How many repairs are open before a mark is a running sum, over the marks of its turn and, one light row a turn, over the turns before; a closing mark without an opening one is left
out by the running minimum of that sum. Marks of one level of a speaker then alternate, so a repair is what stands between an opening mark and the next one of its level. Places are counted in spoken words, so
repairs join with words by their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, POINT, CLOSE = "[", "+", "]"


def _tokens(turns: DataFrame, by: list[str]) -> DataFrame:
    """A row a mark or word of ``turns(by, utt, text)``: by, utt, row (of the turn), i, token."""
    numbered = turns.select(*by, "utt", "text", F.monotonically_increasing_id().alias("row"))
    return numbered.select(*by, "utt", "row", F.posexplode(F.filter(F.split("text", r"\s+"), lambda t: t != "")).alias("i", "token"))


def _running(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Tokens with what stands before each in its speaker's line: ``w`` words, ``plain`` words that are no edit terms, ``depth`` open repairs; and ``is_word``, ``is_plain``."""
    turn = Window.partitionBy(*by, "utt", "row").orderBy("i")
    before, upto = turn.rowsBetween(Window.unboundedPreceding, -1), turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.col("token").isin(OPEN, POINT, CLOSE, "}") | F.col("token").startswith("{")
    braces = F.when(F.col("token").startswith("{") & ~F.col("token").startswith("{C"), 1).when(F.col("token") == "}", 0)
    inside = F.coalesce(F.last(braces, ignorenulls=True).over(upto), F.lit(0)) == 1
    rows = tokens.withColumn("is_word", ~mark).withColumn("is_plain", ~mark & ~inside)
    turns_ago = Window.partitionBy(*by).orderBy("utt", "row").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("token") == OPEN, 1).when(F.col("token") == CLOSE, -1).otherwise(0)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    word, plain = F.col("is_word").cast("int"), F.col("is_plain").cast("int")
    rows = rows.select("*", step.alias("step"), so_far(word, before).alias("w"), so_far(plain, before).alias("plain"), so_far(step, before).alias("s"), so_far(step, upto).alias("s_after"))
    rows = rows.withColumn("least", F.least(F.lit(0), F.coalesce(F.min("s_after").over(before), F.lit(0))))
    sums = rows.groupBy(*by, "utt", "row").agg(F.sum(word).alias("t_w"), F.sum(plain).alias("t_plain"), F.sum("step").alias("t_s"), F.min("s_after").alias("t_least"))
    sums = sums.select("*", *(so_far(f"t_{c}", turns_ago).alias(f"o_{c}") for c in ("w", "plain", "s")))
    sums = sums.withColumn("o_least", F.least(F.lit(0), F.coalesce(F.min(F.col("o_s") + F.col("t_least")).over(turns_ago), F.lit(0))))
    placed = rows.join(sums.select(*by, "utt", "row", "o_w", "o_plain", "o_s", "o_least"), [*by, "utt", "row"])
    depth = F.col("o_s") + F.col("s") - F.least(F.col("o_least"), F.col("o_s") + F.col("least"))
    return placed.select(*by, "utt", "row", "i", "token", "is_word", "is_plain", (F.col("o_w") + F.col("w")).alias("w"), (F.col("o_plain") + F.col("plain")).alias("plain"), depth.alias("depth"))


def markup_repairs(turns: DataFrame, by: list[str], keep=lambda df: df) -> DataFrame:
    """A row a repair of ``turns(by, utt, text)``: by, utt and mark (turn and place in it of the opening mark), level (1: not inside another one), inside (``reparandum`` or ``repair`` of the repair around it, or
    empty), first, point, repair, end (places in the speaker's spoken words where reparandum, interregnum, repair begin and where the repair ends), end_utt.

    Point, repair and end are null where a repair has no ``+`` or is never closed; what is left out for a missing opening mark is no row. The interregnum is the run of edit terms behind the point, no longer than the repair. ``keep`` may write out the
    tokens with their places, which are read twice. Turns that repeat a number are read in any order, one after the other; null texts are empty.
    """
    tokens = keep(_running(_tokens(turns, by), by))
    marks = tokens.filter(F.col("token").isin(OPEN, POINT, CLOSE) & ((F.col("token") == OPEN) | (F.col("depth") > 0)))
    level = F.col("depth") + F.when(F.col("token") == OPEN, 1).otherwise(0)
    place: Column = F.struct("utt", "row", "i", "w", "plain")
    # an opening mark also stands in the level around it, as a child of the repair that is open there
    own = F.struct(level.cast("int").alias("level"), F.col("token").alias("kind"))
    child = F.struct((level - 1).cast("int").alias("level"), F.lit("child").alias("kind"))
    events = marks.select(*by, place.alias("place"), F.explode(F.when((F.col("token") == OPEN) & (F.col("depth") > 0), F.array(own, child)).otherwise(F.array(own))).alias("e")).select(*by, "place", "e.*")
    line = Window.partitionBy(*by, "level").orderBy("place.utt", "place.row", "place.i")
    part = F.last(F.when(F.col("kind").isin(OPEN, POINT), F.col("kind")), ignorenulls=True).over(line)
    runs = events.select("*", F.sum((F.col("kind") == OPEN).cast("int")).over(line).alias("run"), F.when(part == OPEN, "reparandum").otherwise("repair").alias("part"))
    of = lambda k: F.min(F.when(F.col("kind") == k, F.col("place"))).alias(f"at_{k}")
    found = runs.filter("kind <> 'child'").groupBy(*by, "level", "run").agg(of(OPEN).alias("a"), of(POINT).alias("b"), of(CLOSE).alias("c"))
    inside = runs.filter("kind = 'child'").select(*by, (F.col("level") + 1).alias("level"), F.col("place").alias("a"), "part")
    nested = found.join(inside, [*by, "level", "a"], "left")
    # the repair proper begins with the first word behind the point that is no edit term
    plain = tokens.filter("is_plain").select(*by, F.col("plain").alias("__nth"), F.col("w").alias("__next"))
    begun = nested.withColumn("__nth", F.col("b.plain")).join(plain, [*by, "__nth"], "left")
    end = F.col("c.w")
    repair = F.when(F.col("b").isNotNull() & F.col("c").isNotNull(), F.least(F.coalesce(F.col("__next"), end), end))
    return begun.select(
        *by, F.col("a.utt").alias("utt"), F.col("a.i").alias("mark"), "level", F.coalesce("part", F.lit("")).alias("inside"), F.col("a.w").alias("first"), F.col("b.w").alias("point"), repair.alias("repair"), end.alias("end"), F.col("c.utt").alias("end_utt")
    )
