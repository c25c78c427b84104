"""Queries that score hypothesis tags against reference tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palaver.functions import numbers, tags
from palaver.operators import evaluation as ev
from palaver.operators import repairs
from palaver.plans import evaluation as plan

from .base import LINES, TAGGED, WORDS, by_line, sql, table, tagged, words

LINE = ["conv_id", "speaker"]


def prf_word(spark: SparkSession, sf: str) -> DataFrame:
    return ev.with_prf(ev.word_counts(tagged(spark, sf), []))


def prf_by_speaker(spark: SparkSession, sf: str) -> DataFrame:
    return ev.word_counts(tagged(spark, sf), ["speaker"])


def prf_combined(spark: SparkSession, sf: str) -> DataFrame:
    return ev.with_prf(ev.grouped_tags(ev.word_counts(tagged(spark, sf), [])))


def prf_rms_generous(spark: SparkSession, sf: str) -> DataFrame:
    return ev.with_prf(ev.reparandum_matches(repairs.reparanda(tagged(spark, sf), ["gold", "hyp"]), ["conv_id", "utt", "idx"]))


def relaxed_utt(spark: SparkSession, sf: str) -> DataFrame:
    return ev.with_prf(ev.relaxed_by_utterance(tagged(spark, sf), ["conv_id", "utt"]))


def relaxed_10s(spark: SparkSession, sf: str) -> DataFrame:
    return ev.with_prf(ev.relaxed_by_window(tagged(spark, sf), LINE))


def prf_interval(spark: SparkSession, sf: str) -> DataFrame:
    t = tagged(spark, sf)
    side = lambda c, shift: t.filter(F.col(c).contains("<e")).select(*LINE, (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"))
    return ev.with_prf(ev.interval_durations(side("gold", 0), side("hyp", 40), LINE))


def boundary_errors(spark: SparkSession, sf: str) -> DataFrame:
    return ev.boundary_errors(tagged(spark, sf), LINE, "pos")


def speaker_rates(spark: SparkSession, sf: str) -> DataFrame:
    return ev.speaker_rates(tagged(spark, sf), LINE)


def rate_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return ev.correlations(ev.speaker_rates(tagged(spark, sf), LINE), "gold_per_word", "hyp_per_word")


def rate_significance(spark: SparkSession, sf: str) -> DataFrame:
    """How likely by chance the speakers' repair rates agree as they do with the hypothesis' rates, and with the number of the conversation."""
    rates = ev.speaker_rates(tagged(spark, sf), LINE).withColumn("number", F.col("conv_id").cast("double"))
    each = [ev.significances(ev.correlations(rates, "gold_per_word", y)).select(F.lit(y).alias("other"), "*") for y in ("hyp_per_word", "number")]
    both = each[0].unionByName(each[1])
    return both.select("other", "pearson", "spearman", "n", F.round("pearson_p", 6).alias("pearson_p"), F.round("spearman_p", 6).alias("spearman_p"))


def error_by_type(spark: SparkSession, sf: str) -> DataFrame:
    t = tagged(spark, sf)
    gold = t.filter("repair_len > 0").select("conv_id", "utt", "idx", F.col("repair_type").alias("type"), F.col("repair_len").alias("length"))
    return ev.errors_by_type(gold, t.filter(F.col("hyp").contains("<rps")), ["conv_id", "utt", "idx"])


def tag_distribution(spark: SparkSession, sf: str) -> DataFrame:
    n = tagged(spark, sf).groupBy(tags.uttseg_atom(F.col("gold")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("tag", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    kind = lambda c: F.when(F.col(c).contains("<rps"), "repair").when(F.col(c).contains("<rm"), "reparandum").when(F.col(c).contains("<e"), "edit").otherwise("fluent")
    return tagged(spark, sf).select(kind("gold").alias("gold"), kind("hyp").alias("hyp"))


def confusion_top20(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion(_labels(spark, sf), "gold", "hyp").filter("gold <> hyp").orderBy(F.col("n").desc(), "gold", "hyp").limit(20)


def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return ev.classification_report(ev.confusion(_labels(spark, sf), "gold", "hyp"))


def report_averages(spark: SparkSession, sf: str) -> DataFrame:
    return ev.report_averages(classification_report(spark, sf))


def results_table(spark: SparkSession, sf: str) -> DataFrame:
    scores = ev.with_prf(ev.word_counts(tagged(spark, sf), ["speaker"], ("<rps", "<e", "t/>")))
    return scores.groupBy("speaker").pivot("tag", ["<rps", "<e", "t/>"]).agg(F.round(F.first("f1"), 3)).select("speaker", F.col("<rps").alias("f_rps"), F.col("<e").alias("f_e"), F.col("t/>").alias("f_t"))


def metric_rollup(spark: SparkSession, sf: str) -> DataFrame:
    c = ev.word_counts(tagged(spark, sf), ["speaker"])
    return c.rollup("speaker", "tag").agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn"))).select(F.coalesce("speaker", F.lit("*")).alias("speaker"), F.coalesce("tag", F.lit("*")).alias("tag"), "tp", "fp", "fn")


def percentile_nist(spark: SparkSession, sf: str) -> DataFrame:
    return ev.percentiles(words(spark, sf).select("speaker", F.length("word").alias("length")), ["speaker"], "length", (0.0, 10.0, 50.0, 99.9))


def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """All scores of a run in one long table."""
    return plan.evaluate(tagged(spark, sf), LINE, ["conv_id", "utt"])


def error_rates_by_channel(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations in which both channels stay under an error rate of 0.4."""
    t = tagged(spark, sf)
    rate = t.groupBy("conv_id", "speaker").agg(F.round(F.avg((F.col("gold") != F.col("hyp")).cast("int")), 6).alias("rate"))
    return rate.groupBy("conv_id").agg(F.max("rate").alias("worst")).filter("worst < 0.4")


def log_conventions(spark: SparkSession, sf: str) -> DataFrame:
    p = (F.col("event_id") % 9) / F.lit(8.0)
    e = table(spark, sf, "events", "event_id").select(p.alias("p"))
    return e.groupBy("p").agg(F.round(F.sum(numbers.log2_or_zero(F.col("p"))), 6).alias("zero_log"), F.round(F.max(F.when(F.col("p") > 0, numbers.log2_or_minus_inf(F.col("p")))), 6).alias("inf_log"), F.round(F.max(numbers.round_to(F.col("p"), 0.25)), 6).alias("rounded"), F.round(F.max(numbers.safe_div(F.lit(1.0), F.col("p"))), 6).alias("inverse"))


def corpus_statistics(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf)
    u = w.groupBy("speaker", "conv_id", "utt").agg(F.count(F.lit(1)).alias("n_words"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return u.groupBy("speaker", F.least(F.floor(F.col("n_words") / 25), F.lit(6)).alias("bucket")).agg(F.count(F.lit(1)).alias("n_utts"), F.sum("n_words").alias("n_words"), F.sum("ms").alias("ms"))


def repair_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Repairs in ten equal parts of their utterances, by utterance length."""
    t = tagged(spark, sf).filter("repair_len > 0")
    length = F.when(F.col("n") < 20, "short").when(F.col("n") < 80, "middle").otherwise("long")
    return t.groupBy(length.alias("length"), F.floor(F.col("idx") * 10 / F.col("n")).alias("part")).agg(F.count(F.lit(1)).alias("n_repairs"))


def words_per_speaker_join(spark: SparkSession, sf: str) -> DataFrame:
    """Positional zip of two taggings, by key."""
    t = tagged(spark, sf)
    a, b = t.select("conv_id", "utt", "idx", "gold"), t.select("conv_id", "utt", "idx", "hyp")
    return a.join(b, ["conv_id", "utt", "idx"]).groupBy((F.col("gold") == F.col("hyp")).alias("same")).agg(F.count(F.lit(1)).alias("n_words"))


# --- update logs -------------------------------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """An update log over all words: one update a word, which repeats the word before every 5th word and so revokes it."""
    t = by_line(tagged(spark, sf)).select(*LINE, "pos", "word", "start_ms", "end_ms", "gold", "hyp")
    again = t.select("*", F.explode(F.when((F.col("pos") % 5 == 4) & (F.col("pos") > 0), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("back"))
    before = t.select(*LINE, (F.col("pos") + 1).alias("pos"), F.col("word").alias("w1"), F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"), F.col("gold").alias("g1"))
    j = again.join(before, [*LINE, "pos"], "left")
    return j.select(*LINE, F.col("pos").alias("update_no"), F.when(F.col("back") == 1, F.col("pos") - 1).otherwise(F.col("pos")).alias("pos"), F.when(F.col("back") == 1, F.col("w1")).otherwise(F.col("word")).alias("word"), F.when(F.col("back") == 1, F.col("s1")).otherwise(F.col("start_ms")).alias("start_ms"), F.col("end_ms").alias("update_ms"), (F.col("pos") + 1).alias("n_words"), F.when(F.col("back") == 1, F.col("g1")).otherwise(F.col("hyp")).alias("tag"))


def simulate_increco(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).select("conv_id", "update_no", "pos", "word", "start_ms", "update_ms", "tag")


def final_from_increco(spark: SparkSession, sf: str) -> DataFrame:
    return ev.final_hypothesis(_log(spark, sf), LINE).select("conv_id", "pos", "update_no", "word", "tag")


def edit_overhead(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    return ev.edit_overhead(log, ev.final_hypothesis(log, LINE), LINE).drop("speaker")


def time_to_detection(spark: SparkSession, sf: str) -> DataFrame:
    gold = by_line(tagged(spark, sf)).select(*LINE, "pos", "start_ms", "end_ms", F.col("gold").alias("tag"))
    return ev.time_to_detection(_log(spark, sf), gold, LINE, "<rps")


def detection_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every time that an onset was written right, the onset's own word counted."""
    gold = by_line(tagged(spark, sf)).select(*LINE, "pos", "start_ms", "end_ms", F.col("gold").alias("tag"))
    return ev.time_to_detection(_log(spark, sf), gold, LINE, "<rps", first=False, onset=True)


def precision_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """The reference's repairs as if they were hypotheses of the other side."""
    t = tagged(spark, sf)
    found = t.filter(F.col("gold").contains("<rps")).select("conv_id", "utt", "idx", F.col("repair_type").alias("type"), F.col("repair_len").alias("length"))
    return ev.precision_by_type(found, t.filter(F.col("hyp").contains("<rps") & (F.col("idx") % 3 != 0)), ["conv_id", "utt", "idx"])


def segment_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    found = ev.segment_error_rate(tagged(spark, sf), LINE, "pos")
    return found.select(*LINE, "distance", F.round("wer", 6).alias("wer"))


def first_block(spark: SparkSession, sf: str) -> DataFrame:
    """The first update of each log, as the final-output reader takes it."""
    log = _log(spark, sf)
    first = Window.partitionBy(*LINE)
    return log.withColumn("first_no", F.min("update_no").over(first)).filter("update_no = first_no").select("conv_id", "pos", "word", "start_ms")


QUERIES = {
    f.__name__: f
    for f in (
        prf_word, prf_by_speaker, prf_combined, prf_rms_generous, relaxed_utt, relaxed_10s, prf_interval, boundary_errors, speaker_rates, rate_correlation, rate_significance, error_by_type, tag_distribution, confusion_top20, classification_report, report_averages, results_table, metric_rollup,
        percentile_nist, evaluation_report, error_rates_by_channel, log_conventions, corpus_statistics, repair_positions, words_per_speaker_join, simulate_increco, final_from_increco, edit_overhead, time_to_detection, detection_of_all, precision_by_type, segment_error_rate, first_block,
    )
}

_TAGS = "(VALUES " + ", ".join(f"('{t}')" for t in ev.TAGS) + ") v(tag)"
_COUNTS = "CAST(count(*) FILTER (WHERE contains(gold, tag) AND contains(hyp, tag)) AS BIGINT) AS tp, count(*) FILTER (WHERE NOT contains(gold, tag) AND contains(hyp, tag)) AS fp, count(*) FILTER (WHERE contains(gold, tag) AND NOT contains(hyp, tag)) AS fn"
_PRF = "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1"
_ALL = f"SELECT tag, {_COUNTS} FROM tagged, {_TAGS} GROUP BY tag"
_BIG = "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn"
_RELAX = f"SELECT {_BIG}, {_PRF} FROM (SELECT CAST(sum(least(g, h)) AS BIGINT) AS tp, CAST(sum(greatest(0, h - g)) AS BIGINT) AS fp, CAST(sum(greatest(0, g - h)) AS BIGINT) AS fn FROM r)"
_KIND = "CASE WHEN contains({0}, '<rps') THEN 'repair' WHEN contains({0}, '<rm') THEN 'reparandum' WHEN contains({0}, '<e') THEN 'edit' ELSE 'fluent' END AS {0}"
_LABELS = f", lab AS (SELECT {_KIND.format('gold')}, {_KIND.format('hyp')} FROM tagged)"
_REPORT = f""", labels AS (SELECT DISTINCT gold AS label FROM lab UNION SELECT DISTINCT hyp FROM lab),
rep AS (SELECT label, count(*) FILTER (WHERE gold = label) AS support, count(*) FILTER (WHERE gold = label AND hyp = label) AS tp, count(*) FILTER (WHERE gold <> label AND hyp = label) AS fp, count(*) FILTER (WHERE gold = label AND hyp <> label) AS fn FROM lab, labels GROUP BY label),
report AS (SELECT *, {_PRF} FROM rep)"""
_RATES = ", rates AS (SELECT conv_id, speaker, n_words, n_utts, round(gn / n_words, 6) AS gold_per_word, round(gn / n_utts, 6) AS gold_per_utt, round(hn / n_words, 6) AS hyp_per_word, round(hn / n_utts, 6) AS hyp_per_utt FROM (SELECT conv_id, speaker, count(*) AS n_words, count(DISTINCT utt) AS n_utts, count(*) FILTER (WHERE contains(gold, '<rps')) AS gn, count(*) FILTER (WHERE contains(hyp, '<rps')) AS hn FROM tagged GROUP BY 1, 2))"
_LOGS = f""", u AS ({LINES} tagged),
log AS (
  SELECT conv_id, pos AS update_no, pos, word, start_ms, end_ms AS update_ms, pos + 1 AS n_words, hyp AS tag FROM u
  UNION ALL SELECT a.conv_id, a.pos, b.pos, b.word, b.start_ms, a.end_ms, a.pos + 1, b.gold FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.pos = a.pos - 1 WHERE a.pos % 5 = 4),
fin AS (SELECT * FROM log l WHERE NOT EXISTS (SELECT 1 FROM log m WHERE m.conv_id = l.conv_id AND m.update_no > l.update_no AND m.start_ms <= l.start_ms))"""

ORACLES = {
    "prf_word": sql(TAGGED, f"SELECT tag, {_BIG}, {_PRF} FROM ({_ALL})"),
    "prf_by_speaker": sql(TAGGED, f"SELECT speaker, tag, {_COUNTS} FROM tagged, {_TAGS} GROUP BY 1, 2"),
    "prf_combined": sql(TAGGED, f"SELECT tag, {_BIG}, {_PRF} FROM (SELECT '<rm.<i.<rp' AS tag, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM ({_ALL}) WHERE tag IN ('<rm', '<i', '<rp'))"),
    "prf_rms_generous": sql(
        TAGGED,
        f""", l AS (SELECT conv_id, utt, list(word ORDER BY idx) AS line, list(hyp ORDER BY idx) AS hyps FROM tagged GROUP BY 1, 2),
g AS (SELECT conv_id, utt, idx - repair_len AS idx, array_to_string(line[idx - repair_len + 1:idx], ' ') AS words FROM tagged JOIN l USING (conv_id, utt) WHERE repair_len > 0),
a AS (SELECT conv_id, utt, idx, word, unnest(regexp_extract_all(hyp, '<(rms|rm|rps) id="[0-9]+"/>', 0)) AS atom FROM tagged),
b AS (SELECT conv_id, utt, regexp_extract(atom, '[0-9]+') AS id, min(idx) FILTER (WHERE atom LIKE '<rms%') AS idx, coalesce(string_agg(word, ' ' ORDER BY idx) FILTER (WHERE atom LIKE '<rm%'), '') AS words, count(*) FILTER (WHERE atom LIKE '<rps%') AS n_rps FROM a GROUP BY 1, 2, 3),
h AS (SELECT conv_id, utt, idx, words FROM b WHERE n_rps > 0 AND idx IS NOT NULL),
gn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, utt, idx, words) AS k, 1 AS g FROM g), hn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, utt, idx, words) AS k, 1 AS h FROM h)
SELECT *, {_PRF} FROM (SELECT count(*) FILTER (WHERE g = 1 AND h = 1) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE h IS NULL) AS fn FROM gn FULL JOIN hn USING (conv_id, utt, idx, words, k))""",
    ),
    "relaxed_utt": sql(TAGGED, f", r AS (SELECT conv_id, utt, count(*) FILTER (WHERE contains(gold, '<rps')) AS g, count(*) FILTER (WHERE contains(hyp, '<rps')) AS h FROM tagged GROUP BY 1, 2) {_RELAX}"),
    "relaxed_10s": sql(TAGGED, f", r AS (SELECT conv_id, speaker, start_ms // 10000 AS w, count(*) FILTER (WHERE contains(gold, '<rps')) AS g, count(*) FILTER (WHERE contains(hyp, '<rps')) AS h FROM tagged WHERE start_ms // 10000 = end_ms // 10000 GROUP BY 1, 2, 3) {_RELAX}"),
    "prf_interval": sql(
        TAGGED,
        f""", g AS (SELECT conv_id, speaker, start_ms AS s, end_ms AS e FROM tagged WHERE contains(gold, '<e')), h AS (SELECT conv_id, speaker, start_ms + 40 AS s, end_ms + 40 AS e FROM tagged WHERE contains(hyp, '<e')),
o AS (SELECT CAST(sum(least(g.e, h.e) - greatest(g.s, h.s)) AS BIGINT) AS tp FROM g JOIN h ON g.conv_id = h.conv_id AND g.speaker = h.speaker AND h.e > g.s AND h.s < g.e)
SELECT *, {_PRF} FROM (SELECT tp, (SELECT CAST(sum(e - s) AS BIGINT) FROM h) - tp AS fp, (SELECT CAST(sum(e - s) AS BIGINT) FROM g) - tp AS fn FROM o)""",
    ),
    "boundary_errors": sql(
        TAGGED,
        """, b AS (SELECT conv_id, speaker, pos, contains(gold, 't/>') AS g, contains(hyp, 't/>') AS h FROM tagged),
s AS (SELECT *, coalesce(sum(g::INT) OVER (PARTITION BY conv_id, speaker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM b),
t AS (SELECT conv_id, speaker, seg, bool_or(g) AS ends, bool_or(g <> h) AS wrong, count(*) FILTER (WHERE g AND h) AS tp, count(*) FILTER (WHERE h AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT h) AS fn FROM s GROUP BY 1, 2, 3),
z AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) FILTER (WHERE ends) AS segments, count(*) FILTER (WHERE ends AND wrong) AS bad FROM t)
SELECT *, round(CASE WHEN fp + fn = 0 THEN 0 ELSE (fp + fn) * 100.0 / (tp + fn) END, 6) AS nist_su, round(100.0 * bad / segments, 6) AS dser FROM z""",
    ),
    "speaker_rates": sql(TAGGED, _RATES + " SELECT * FROM rates"),
    "rate_correlation": sql(
        TAGGED,
        _RATES
        + """, k AS (SELECT gold_per_word AS x, hyp_per_word AS y, rank() OVER (ORDER BY gold_per_word) + (count(*) OVER (PARTITION BY gold_per_word) - 1) / 2.0 AS rx, rank() OVER (ORDER BY hyp_per_word) + (count(*) OVER (PARTITION BY hyp_per_word) - 1) / 2.0 AS ry FROM rates)
SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM k""",
    ),
    # Student's distribution by Simpson's rule over cos(t)^(n - 3)
    "rate_significance": sql(
        TAGGED,
        _RATES
        + """, y AS (SELECT 'hyp_per_word' AS other, gold_per_word AS x, hyp_per_word AS y FROM rates UNION ALL SELECT 'number', gold_per_word, CAST(conv_id AS DOUBLE) FROM rates),
k AS (SELECT *, rank() OVER (PARTITION BY other ORDER BY x) + (count(*) OVER (PARTITION BY other, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY other ORDER BY y) + (count(*) OVER (PARTITION BY other, y) - 1) / 2.0 AS ry FROM y),
c AS (SELECT other, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM k GROUP BY 1),
g AS (SELECT unnest(range(4001)) AS i),
w AS (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM g),
s AS (SELECT other, k, least(1, CASE WHEN sum(w * pow(cos(pi() / 2 * i / 4000), n - 3)) = 0 THEN 0 ELSE (1 - 2 / pi() * asin(abs(r))) * sum(w * pow(cos(asin(abs(r)) + (pi() / 2 - asin(abs(r))) * i / 4000), n - 3)) / sum(w * pow(cos(pi() / 2 * i / 4000), n - 3)) END) AS p
  FROM (SELECT other, n, 'pearson' AS k, pearson AS r FROM c UNION ALL SELECT other, n, 'spearman', spearman FROM c), w GROUP BY other, k, r)
SELECT other, pearson, spearman, n, round((SELECT p FROM s WHERE s.other = c.other AND s.k = 'pearson'), 6) AS pearson_p, round((SELECT p FROM s WHERE s.other = c.other AND s.k = 'spearman'), 6) AS spearman_p FROM c""",
    ),
    "error_by_type": sql(TAGGED, "SELECT repair_type AS type, repair_len AS length, count(*) AS n_gold, count(*) FILTER (WHERE contains(hyp, '<rps')) AS n_found, round(count(*) FILTER (WHERE contains(hyp, '<rps')) / count(*), 6) AS recall FROM tagged WHERE repair_len > 0 GROUP BY 1, 2"),
    "tag_distribution": sql(TAGGED, "SELECT regexp_extract(gold, '<[ct]*/>') AS tag, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM tagged GROUP BY 1"),
    "confusion_top20": sql(TAGGED, _LABELS + " SELECT gold, hyp, count(*) AS n FROM lab WHERE gold <> hyp GROUP BY 1, 2 ORDER BY n DESC, gold, hyp LIMIT 20"),
    "classification_report": sql(TAGGED, _LABELS + _REPORT + " SELECT * FROM report"),
    "report_averages": sql(TAGGED, _LABELS + _REPORT + " SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(tp) / sum(support), 6) AS accuracy FROM report WHERE support > 0"),
    "results_table": sql(TAGGED, f", c AS (SELECT speaker, tag, {_COUNTS} FROM tagged, {_TAGS} GROUP BY 1, 2), d AS (SELECT speaker, tag, {_PRF} FROM c) SELECT speaker, {', '.join(f"round(max(f1) FILTER (WHERE tag = '{t}'), 3) AS {n}" for t, n in (('<rps', 'f_rps'), ('<e', 'f_e'), ('t/>', 'f_t')))} FROM d GROUP BY 1"),
    "metric_rollup": sql(TAGGED, f", c AS (SELECT speaker, tag, {_COUNTS} FROM tagged, {_TAGS} GROUP BY 1, 2) SELECT coalesce(speaker, '*') AS speaker, coalesce(tag, '*') AS tag, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY ROLLUP (speaker, tag)"),
    "percentile_nist": sql(
        WORDS,
        ", v AS (SELECT speaker, list_sort(list(length(word))) AS v FROM words GROUP BY 1) SELECT speaker, "
        + ", ".join(f"CAST(round(CASE WHEN floor({p} / 100.0 * len(v)) = 0 THEN v[1] WHEN floor({p} / 100.0 * len(v)) >= len(v) - 1 THEN v[len(v)] ELSE v[CAST(floor({p} / 100.0 * len(v)) AS INT)] + ({p} / 100.0 * len(v) - floor({p} / 100.0 * len(v))) * (v[CAST(floor({p} / 100.0 * len(v)) AS INT) + 1] - v[CAST(floor({p} / 100.0 * len(v)) AS INT)]) END, 6) AS DOUBLE) AS p{int(p)}" for p in (0.0, 10.0, 50.0, 99.9))
        + " FROM v",
    ),
    "error_rates_by_channel": sql(TAGGED, "SELECT conv_id, max(rate) AS worst FROM (SELECT conv_id, speaker, round(avg((gold <> hyp)::INT), 6) AS rate FROM tagged GROUP BY 1, 2) GROUP BY 1 HAVING max(rate) < 0.4"),
    "log_conventions": "WITH e AS (SELECT event_id % 9 / 8 AS p FROM events) SELECT p, round(sum(CASE WHEN p = 0 THEN 0 ELSE log2(p) END), 6) AS zero_log, round(max(CASE WHEN p > 0 THEN log2(p) END), 6) AS inf_log, round(max(round(p / 0.25) * 0.25), 6) AS rounded, round(max(CASE WHEN p = 0 THEN 0 ELSE 1 / p END), 6) AS inverse FROM e GROUP BY p",
    "corpus_statistics": sql(WORDS, "SELECT speaker, least(n // 25, 6) AS bucket, count(*) AS n_utts, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(ms) AS BIGINT) AS ms FROM (SELECT speaker, conv_id, utt, count(*) AS n, sum(end_ms - start_ms) AS ms FROM words GROUP BY 1, 2, 3) GROUP BY 1, 2"),
    "repair_positions": sql(TAGGED, "SELECT CASE WHEN n < 20 THEN 'short' WHEN n < 80 THEN 'middle' ELSE 'long' END AS length, CAST(idx * 10 // n AS BIGINT) AS part, count(*) AS n_repairs FROM tagged WHERE repair_len > 0 GROUP BY 1, 2"),
    "words_per_speaker_join": sql(TAGGED, "SELECT gold = hyp AS same, count(*) AS n_words FROM tagged GROUP BY 1"),
    "simulate_increco": sql(TAGGED + _LOGS, "SELECT conv_id, update_no, pos, word, start_ms, update_ms, tag FROM log"),
    "final_from_increco": sql(TAGGED + _LOGS, "SELECT conv_id, pos, update_no, word, tag FROM fin"),
    "edit_overhead": sql(TAGGED + _LOGS, "SELECT conv_id, edits, final_words, round(100 * (edits / final_words - 1), 6) AS overhead FROM (SELECT conv_id, count(*) AS edits FROM log GROUP BY 1) JOIN (SELECT conv_id, count(*) AS final_words FROM fin GROUP BY 1) USING (conv_id)"),
    "time_to_detection": sql(
        TAGGED + _LOGS,
        """, d AS (SELECT l.conv_id, l.pos, arg_min(l.n_words - l.pos - 1, l.update_no) AS words, arg_min(l.update_ms - u.end_ms, l.update_no) AS ms, arg_min(l.update_ms - u.start_ms, l.update_no) AS ms2 FROM log l JOIN u ON u.conv_id = l.conv_id AND u.pos = l.pos WHERE contains(u.gold, '<rps') AND contains(l.tag, '<rps') GROUP BY 1, 2)
SELECT round(avg(words), 6) AS words, round(avg(ms), 6) AS ms, round(avg(ms2), 6) AS ms_from_start, count(*) AS n_detected FROM d""",
    ),
    "detection_of_all": sql(
        TAGGED + _LOGS,
        "SELECT round(avg(l.n_words - l.pos), 6) AS words, round(avg(l.update_ms - u.end_ms), 6) AS ms, round(avg(l.update_ms - u.start_ms), 6) AS ms_from_start, count(*) AS n_detected FROM log l JOIN u ON u.conv_id = l.conv_id AND u.pos = l.pos WHERE contains(u.gold, '<rps') AND contains(l.tag, '<rps')",
    ),
    "precision_by_type": sql(TAGGED, "SELECT repair_type AS type, repair_len AS length, count(*) AS n_hyp, count(*) FILTER (WHERE contains(hyp, '<rps') AND idx % 3 <> 0) AS n_right, round(count(*) FILTER (WHERE contains(hyp, '<rps') AND idx % 3 <> 0) / count(*), 6) AS precision FROM tagged WHERE contains(gold, '<rps') GROUP BY 1, 2"),
    "segment_error_rate": sql(TAGGED, "SELECT conv_id, speaker, CAST(levenshtein(g, h) AS INTEGER) AS distance, round(100.0 * levenshtein(g, h) / length(g), 6) AS wer FROM (SELECT conv_id, speaker, string_agg(CASE WHEN contains(gold, 't/>') THEN 't' ELSE 'c' END, '' ORDER BY pos) AS g, string_agg(CASE WHEN contains(hyp, 't/>') THEN 't' ELSE 'c' END, '' ORDER BY pos) AS h FROM tagged GROUP BY 1, 2)"),
    "first_block": sql(TAGGED + _LOGS, "SELECT conv_id, pos, word, start_ms FROM log WHERE update_no = 0"),
}
ORACLES = {k: v.replace("\n, ", ",\n", 1) if v.startswith("WITH") else v for k, v in ORACLES.items()}


def _long(query: str, prefix: str, columns: tuple[str, ...], tag: str = "''") -> list[str]:
    return [f"SELECT '{prefix}{c}' AS metric, {tag} AS tag, CAST({c} AS DOUBLE) AS value FROM ({ORACLES[query]})" for c in columns]


_SCORES = ("precision", "recall", "f1")
ORACLES["evaluation_report"] = "\nUNION ALL ".join(
    _long("prf_word", "word_", _SCORES, "tag") + _long("prf_combined", "word_", _SCORES, "tag") + _long("relaxed_utt", "utterance_", _SCORES) + _long("relaxed_10s", "window_", _SCORES) + _long("boundary_errors", "", ("nist_su", "dser")) + _long("rate_correlation", "", ("pearson", "spearman"))
)
