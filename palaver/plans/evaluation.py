"""The evaluation of a tagging run as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palaver.operators import evaluation as ev
from palaver.sources import readers


def evaluate(tagged: DataFrame, by: list[str], unit: list[str], order: str = "pos", word: bool = True, relaxed: bool = True, boundaries: bool = True, rates: bool = True) -> DataFrame:
    """(metric, tag, value) of ``tagged`` (gold and hyp per word, with start_ms and end_ms): scores by word, relaxed scores, boundary errors and the
    correlation of speaker rates. ``by`` names a speaker's word line, ``unit`` an utterance."""
    parts = []
    long = lambda df, prefix, columns, tag: df.select(F.explode(F.array(*(F.struct(F.lit(f"{prefix}{c}").alias("metric"), (F.col(tag) if tag else F.lit("")).alias("tag"), F.col(c).cast("double").alias("value")) for c in columns))).alias("m")).select("m.*")
    scores = ("precision", "recall", "f1")
    if word:
        counts = ev.word_counts(tagged, [])
        parts += [long(ev.with_prf(counts), "word_", scores, "tag"), long(ev.with_prf(ev.grouped_tags(counts)), "word_", scores, "tag")]
    if relaxed:
        parts += [long(ev.with_prf(ev.relaxed_by_utterance(tagged, unit)), "utterance_", scores, None), long(ev.with_prf(ev.relaxed_by_window(tagged, by)), "window_", scores, None)]
    if boundaries:
        parts.append(long(ev.boundary_errors(tagged, by, order), "", ("nist_su", "dser"), None))
    if rates:
        parts.append(long(ev.correlations(ev.speaker_rates(tagged, by), "gold_per_word", "hyp_per_word"), "", ("pearson", "spearman"), None))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluate_files(spark: SparkSession, gold: str, hyp: str) -> DataFrame:
    """``evaluate`` over timed corpus files of the same words. An utterance ends where the reference says so."""
    read = lambda path, tag: readers.timed_corpus(spark, path, limit=False).select("speaker", "pos", "word", *((F.col(c) * 1000).cast("long").alias(f"{c}_ms") for c in ("start", "end")), F.col("tag").alias(tag))
    both = read(gold, "gold").join(read(hyp, "hyp").select("speaker", "pos", "hyp"), ["speaker", "pos"])
    before = Window.partitionBy("speaker").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    utt = F.coalesce(F.sum(F.col("gold").contains("t/>").cast("long")).over(before), F.lit(0))
    return evaluate(both.withColumn("utt", utt), ["speaker"], ["speaker", "utt"])
