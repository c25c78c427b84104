"""Scores of hypothesis tags against reference tags: by word, by time, by boundary, incremental, by speaker.

A tag of interest counts on a word if the word's tag string contains it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palaver.functions.numbers import correlation_p, f_score, precision, recall, safe_div, segmentation_error

from .alignment import distances
from .joins import interval_join
from .sequences import running_total

# fixed values: the tags that are scored
TAGS = ("<rms", "<rm", "<i", "<rps", "<rp", "<rpn", "<rpnrep", "<rpnsub", "<rpndel", "<e", "t/>")
GROUPS = {"<rm.<i.<rp": ("<rm", "<i", "<rp")}


def with_prf(df: DataFrame) -> DataFrame:
    """``df`` with tp, fp, fn: adds precision, recall and f1 (0 without hits)."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return df.withColumn("precision", F.round(precision(tp, fp), 6)).withColumn("recall", F.round(recall(tp, fn), 6)).withColumn("f1", F.round(f_score(tp, fp, fn), 6))


def word_counts(df: DataFrame, by: list[str], tags: tuple[str, ...] = TAGS, gold: str = "gold", hyp: str = "hyp") -> DataFrame:
    """tag, tp, fp, fn by ``by``. All tags are counted in one pass: 3 sums a tag, one row a group, unpivoted at the end."""
    sums = []
    for i, t in enumerate(tags):
        g, h = F.col(gold).contains(t), F.col(hyp).contains(t)
        sums += [F.sum((g & h).cast("long")).alias(f"tp{i}"), F.sum((~g & h).cast("long")).alias(f"fp{i}"), F.sum((g & ~h).cast("long")).alias(f"fn{i}")]
    counts = df.groupBy(*by).agg(*sums)
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), *(F.coalesce(F.col(f"{k}{i}"), F.lit(0).cast("long")).alias(k) for k in ("tp", "fp", "fn"))) for i, t in enumerate(tags))))
    return counts.select(*by, rows.alias("r")).select(*by, "r.*")


def grouped_tags(counts: DataFrame, groups: dict[str, tuple[str, ...]] = GROUPS) -> DataFrame:
    """Counts of tag groups: the sums of their members."""
    member = F.explode(F.array(*(F.struct(F.lit(g).alias("group"), F.lit(t).alias("member")) for g, ts in groups.items() for t in ts)))
    named = counts.sparkSession.range(1).select(member.alias("m")).select("m.*")
    return counts.join(F.broadcast(named), F.col("tag") == F.col("member")).groupBy(F.col("group").alias("tag")).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def reparandum_matches(repairs: DataFrame, at: list[str], gold: str = "gold") -> DataFrame:
    """tp, fp, fn of repairs that begin at the same word with equal reparandum words; each hypothesis is used once.

    ``repairs``: side (``gold`` or another), ``at`` columns and ``reparandum``, several rows a word allowed.
    """
    n = repairs.groupBy(*at, "reparandum").agg(F.sum((F.col("side") == gold).cast("long")).alias("g"), F.sum((F.col("side") != gold).cast("long")).alias("h"))
    one = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    both = F.least("g", "h")
    return n.agg(one(both).alias("tp"), one(F.col("h") - both).alias("fp"), one(F.col("g") - both).alias("fn"))


def _relaxed(df: DataFrame, unit: list[str], tag: str, gold: str, hyp: str) -> DataFrame:
    n = df.groupBy(*unit).agg(F.sum(F.col(gold).contains(tag).cast("long")).alias("g"), F.sum(F.col(hyp).contains(tag).cast("long")).alias("h"))
    zero = F.lit(0).cast("long")
    return n.agg(F.sum(F.least("g", "h")).alias("tp"), F.sum(F.greatest(zero, F.col("h") - F.col("g"))).alias("fp"), F.sum(F.greatest(zero, F.col("g") - F.col("h"))).alias("fn"))


def relaxed_by_utterance(df: DataFrame, unit: list[str], tag: str = "<rps", gold: str = "gold", hyp: str = "hyp") -> DataFrame:
    """Counts matched within utterances, wherever in them."""
    return _relaxed(df, unit, tag, gold, hyp)


def relaxed_by_window(df: DataFrame, by: list[str], width_ms: int = 10_000, tag: str = "<rps", gold: str = "gold", hyp: str = "hyp") -> DataFrame:
    """Counts matched within windows of ``width_ms``. A word that is not wholly inside one window counts in none, nor does a word that ends with it."""
    inside = df.withColumn("window", F.floor(F.col("start_ms") / width_ms)).filter(F.col("window") == F.floor(F.col("end_ms") / width_ms))
    return _relaxed(inside, [*by, "window"], tag, gold, hyp)


def interval_durations(gold: DataFrame, hyp: DataFrame, by: list[str], bucket: int = 2_000) -> DataFrame:
    """tp, fp, fn in milliseconds: the overlap of the tagged intervals, and what is left of each side."""
    total = lambda df, name: df.agg(F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")), F.lit(0)).alias(name))
    shared = interval_join(gold, hyp, by, bucket).agg(F.coalesce(F.sum(F.col("overlap_end") - F.col("overlap_start")), F.lit(0)).alias("tp"))
    return shared.crossJoin(total(hyp, "h")).crossJoin(total(gold, "g")).select("tp", (F.col("h") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))


def boundary_errors(df: DataFrame, by: list[str], order: str, tag: str = "t/>", gold: str = "gold", hyp: str = "hyp") -> DataFrame:
    """nist_su (wrong boundaries per 100) and dser (share of reference segments, in percent, that are not found exactly)."""
    g, h = F.col(gold).contains(tag), F.col(hyp).contains(tag)
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    words = df.select(*by, order, g.alias("g"), h.alias("h")).withColumn("segment", F.coalesce(F.sum(F.col("g").cast("long")).over(before), F.lit(0)))
    segments = words.groupBy(*by, "segment").agg(F.max("g").alias("ends"), F.max(F.col("g") != F.col("h")).alias("wrong"), *(F.sum(c.cast("long")).alias(n) for n, c in (("tp", F.col("g") & F.col("h")), ("fp", ~F.col("g") & F.col("h")), ("fn", F.col("g") & ~F.col("h")))))
    sums = segments.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.sum((F.col("ends") & F.col("wrong")).cast("long")).alias("bad"), F.sum(F.col("ends").cast("long")).alias("segments"))
    return sums.select("tp", "fp", "fn", "segments", "bad", F.round(segmentation_error(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("nist_su"), F.round(100 * safe_div(F.col("bad"), F.col("segments")), 6).alias("dser"))


def speaker_rates(df: DataFrame, by: list[str], tag: str = "<rps") -> DataFrame:
    """Repairs per word and per utterance of each speaker, reference and hypothesis."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_words"), F.countDistinct("utt").alias("n_utts"), *(F.sum(F.col(c).contains(tag).cast("long")).alias(f"{c}_n") for c in ("gold", "hyp")))
    return n.select(*by, "n_words", "n_utts", *(F.round(safe_div(F.col(f"{c}_n"), F.col(f"n_{u}")), 6).alias(f"{c}_per_{u[:-1]}") for c in ("gold", "hyp") for u in ("words", "utts")))


def percentiles(df: DataFrame, by: list[str], value: str, ps: tuple[float, ...]) -> DataFrame:
    """``by`` and a column p0, p10, ... for each percentile: rank = p / 100 * n; the first value below rank 1, the last from rank n - 1 on, else
    between the two values around the rank. Values are counted, not collected: a row a distinct value."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*by)
    upto = counts.withColumn("__upto", F.sum("__n").over(whole.orderBy(value))).withColumn("__all", F.sum("__n").over(whole))
    out = []
    for p in ps:
        rank = F.lit(p) / F.lit(100.0) * F.col("__all")
        k = F.floor(rank)
        at = lambda i: F.max(F.when((F.col("__upto") >= i) & (F.col("__upto") - F.col("__n") < i), F.col(value)))
        out.append(F.struct(F.max(k).alias("k"), F.max(rank).alias("rank"), at(k).alias("low"), at(k + 1).alias("high")).alias(f"__p{p}"))
    ends = upto.groupBy(*by).agg(F.max("__all").alias("__all"), F.min(value).alias("__first"), F.max(value).alias("__last"), *out)
    pick = lambda s: F.when(s["k"] == 0, F.col("__first")).when(s["k"] >= F.col("__all") - 1, F.col("__last")).otherwise(s["low"] + (s["rank"] - s["k"]) * (s["high"] - s["low"]))
    return ends.select(*by, *(F.round(pick(F.col(f"`__p{p}`")), 6).alias(f"p{int(p)}") for p in ps))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the rank of ``value`` under ``name``, ties averaged. Distinct values are numbered by ranges; no task sorts all rows."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_total(counts, value, "__n", "__before").select(F.col(value).alias("__value"), (F.col("__before") + (F.col("__n") + 1) / F.lit(2.0)).alias(name))
    return df.join(ranked, F.col(value).eqNullSafe(F.col("__value"))).drop("__value")


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r and Spearman's rho over the rows (one a speaker)."""
    ranked = average_ranks(average_ranks(df.select(x, y), x, "rx"), y, "ry")
    return ranked.agg(F.round(F.corr(x, y), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"), F.count(F.lit(1)).alias("n"))


def significances(correlated: DataFrame) -> DataFrame:
    """``correlations`` with the probability of each by chance: pearson_p and spearman_p."""
    return correlated.select("*", *(correlation_p(F.col(c), F.col("n")).alias(f"{c}_p") for c in ("pearson", "spearman")))


def errors_by_type(repairs: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Recall by repair type and reparandum length: ``repairs`` with type and length, ``found`` with the keys that were found."""
    hit = repairs.join(found.select(*key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return hit.groupBy("type", "length").agg(F.count(F.lit(1)).alias("n_gold"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n_gold"), 6))


def confusion(df: DataFrame, gold: str, hyp: str) -> DataFrame:
    return df.groupBy(F.col(gold).alias("gold"), F.col(hyp).alias("hyp")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(pairs: DataFrame) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1 from confusion counts (gold, hyp, n)."""
    by_gold = pairs.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("hyp"), F.col("n")).otherwise(0)).alias("tp"))
    by_hyp = pairs.groupBy(F.col("hyp").alias("label")).agg(F.sum("n").alias("predicted"))
    zero = F.lit(0).cast("long")
    both = by_gold.join(by_hyp, "label", "full").select("label", F.coalesce("support", zero).alias("support"), F.coalesce("tp", zero).alias("tp"), F.coalesce("predicted", zero).alias("predicted"))
    return with_prf(both.select("label", "support", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn")))


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted F over the labels that occur in the reference, and accuracy."""
    r = report.filter("support > 0")
    return r.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"), F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"))


def final_hypothesis(log: DataFrame, by: list[str]) -> DataFrame:
    """The words that stand at the end of an update log (by, update_no, pos_in_update, start_ms, word, ...). A word stands unless a later update
    starts at or before its start; the updates after a row are summed up by a running minimum from the end."""
    first = log.groupBy(*by, "update_no").agg(F.min("start_ms").alias("from_ms"))
    later = Window.partitionBy(*by).orderBy(F.col("update_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    revoked = first.withColumn("revoked_from", F.min("from_ms").over(later)).select(*by, "update_no", "revoked_from")
    return log.join(revoked, [*by, "update_no"]).filter(F.col("revoked_from").isNull() | (F.col("start_ms") < F.col("revoked_from"))).drop("revoked_from")


def edit_overhead(log: DataFrame, final: DataFrame, by: list[str]) -> DataFrame:
    """Percent of word edits beyond those that the final hypothesis needs."""
    made = log.groupBy(*by).agg(F.count(F.lit(1)).alias("edits"))
    kept = final.groupBy(*by).agg(F.count(F.lit(1)).alias("final_words"))
    return made.join(kept, by).withColumn("overhead", F.round(100 * (F.col("edits") / F.col("final_words") - 1), 6))


def time_to_detection(log: DataFrame, gold: DataFrame, by: list[str], tag: str, first: bool = True, onset: bool = False) -> DataFrame:
    """How many words (``words``) and milliseconds after a tagged word's start (``ms_from_start``) and end (``ms``) the hypothesis had the tag right: the ``first`` time, or each time that it wrote it.
    For tags of repair onsets (``onset``) the word itself counts too.

    ``log``: by, update_no, update_ms, pos, n_words (length of the hypothesis then), tag; ``gold``: by, pos, start_ms, end_ms, tag.
    """
    right = log.join(gold.filter(F.col("tag").contains(tag)).select(*by, "pos", F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms")), [*by, "pos"]).filter(F.col("tag").contains(tag))
    if first:
        right = right.groupBy(*by, "pos").agg(F.min_by(F.struct("n_words", "update_ms", "from_ms", "to_ms"), "update_no").alias("f")).select(*by, "pos", "f.*")
    r = lambda c: F.round(F.avg(c), 6)
    return right.agg(r(F.col("n_words") - F.col("pos") - 1 + int(onset)).alias("words"), r(F.col("update_ms") - F.col("to_ms")).alias("ms"), r(F.col("update_ms") - F.col("from_ms")).alias("ms_from_start"), F.count(F.lit(1)).alias("n_detected"))


def precision_by_type(found: DataFrame, repairs: DataFrame, key: list[str]) -> DataFrame:
    """Precision by repair type and reparandum length: ``found`` hypotheses with type and length, ``repairs`` with the keys that are right."""
    return errors_by_type(found, repairs, key).select("type", "length", F.col("n_gold").alias("n_hyp"), F.col("n_found").alias("n_right"), F.col("recall").alias("precision"))


def segment_error_rate(df: DataFrame, by: list[str], order: str, tag: str = "t/>", gold: str = "gold", hyp: str = "hyp") -> DataFrame:
    """``by``, distance and wer: edit distance of the two boundary vectors of a speaker's words, and its percentage of the reference's length."""
    vector = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(c).contains(tag).cast("string").alias("b")))), lambda s: s["b"])
    return distances(df.groupBy(*by).agg(vector(gold).alias("__gold"), vector(hyp).alias("__hyp")), "__gold", "__hyp")
