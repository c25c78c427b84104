"""Queries over corpus preparation: schemes, fix-ups, shuffles, folds, maps and alignments of whole corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palaver.functions import text
from palaver.operators import alignment, decoding, repairs
from palaver.operators import language_model as lm
from palaver.operators import sequences as seq
from palaver.sources import readers, writers

from .base import TAGGED, WORDS, folder, materialised, sql, table, tagged, words
from .modelling import _emissions, _length_tokens, _sentences, _viterbi_ctes

UTT = ["conv_id", "utt"]
LINE = ["conv_id", "speaker"]


def _listed(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.groupBy(*UTT).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(value).alias("v")))), lambda s: s["v"]).alias(name))


def scheme_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Left-to-right tags with acts and laughter carried over, and reparanda counted without edit terms."""
    act = F.concat(F.lit('<diact type="'), F.substring("speaker", 1, 2), F.lit('"/>'))
    laugh = F.when(F.col("pos") % 19 == 0, "<laughter/>").when(F.col("pos") % 23 == 0, "<speechLaugh/>").otherwise("")
    t = tagged(spark, sf).withColumn("gold", F.concat("gold", act, laugh))
    every = repairs.to_incremental(t, carry=("uttseg", "dact", "laugh")).select(*UTT, "idx", F.col("inc").alias("full"))
    few = repairs.to_incremental(t, carry=(), count_edits=False).select(*UTT, "idx", F.col("inc").alias("without_edits"))
    return every.join(few, [*UTT, "idx"])


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    """Words whose repairs have lost some ends and onsets, and edit terms before some onsets."""
    tag = F.when(F.col("pos") % 7 == 0, F.regexp_replace("gold", "<rpn[a-z]* id=", "<rp id=")).when(F.col("pos") % 13 == 0, F.regexp_replace("gold", '<rps id="[0-9]+"/>', "")).otherwise(F.col("gold"))
    return tagged(spark, sf).select(*UTT, "idx", "pos", "speaker", "word", "n", "repair_len", "repair_type", tag.alias("tag"))


def open_repairs(spark: SparkSession, sf: str) -> DataFrame:
    """Repairs without an end get one."""
    t = _broken(spark, sf)
    t = t.withColumn("tag", F.regexp_replace("tag", '<rp id="([0-9]+)"/>', ""))
    return repairs.ends_for_open_repairs(t).select(*UTT, "idx", "tag").filter(F.col("tag").contains("<rpn"))


def broken_repairs(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the tags when repairs that are not whole go."""
    return repairs.without_broken_repairs(_broken(spark, sf)).select(*UTT, "idx", "tag")


def retyped_repairs(spark: SparkSession, sf: str) -> DataFrame:
    """Repetitions and substitutions named anew."""
    t = tagged(spark, sf).withColumn("tag", F.regexp_replace("gold", "<rpnrep ", "<rpnsub "))
    return repairs.retyped(t).select(*UTT, "idx", "tag").filter(F.col("tag").contains("<rpn"))


def interregna_before_onsets(spark: SparkSession, sf: str) -> DataFrame:
    t = tagged(spark, sf).withColumnRenamed("gold", "tag")
    return repairs.marked_interregna(t).select(*UTT, "idx", "tag").filter(F.col("tag").contains("<i "))


def cross_turn_repairs(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf).withColumn("word", F.substring("word", 1, 2))
    return repairs.cross_turn_repairs(w, LINE, "idx", reach=3)


def best_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The three best last labels of every utterance, with their paths."""
    rows = _emissions(spark, sf).groupBy(*UTT).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "e"))), lambda s: s["e"]).alias("emissions"))
    found = decoding.best_paths(rows, list(decoding.STATES), decoding.constraint_weights(), 3)
    each = found.select(*UTT, F.posexplode("paths").alias("rank", "p"))
    return each.select(*UTT, "rank", F.concat_ws(",", F.col("p.path").cast("array<string>")).alias("path"), F.round("p.score", 6).alias("score"))


def letter_times(spark: SparkSession, sf: str) -> DataFrame:
    """Words of an utterance that share its time by their letters."""
    w = words(spark, sf)
    lines = w.groupBy(*UTT).agg(F.min("start_ms").alias("s"), (F.max("end_ms") + F.max("n")).alias("e"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]).alias("w"))
    return lines.select(*UTT, F.posexplode(alignment.shared_time(F.col("s"), F.col("e"), F.col("w"))).alias("idx", "t")).select(*UTT, "idx", "t.word", "t.start", "t.end")


def common_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Matching blocks of two or more words between what was said and a recogniser's version of it."""
    return alignment.common_runs(_length_tokens(words(spark, sf)), "ref", "hyp", 2).select(*UTT, F.transform("blocks", lambda b: F.concat_ws(":", b["source"], b["goal"], b["length"])).alias("blocks"))


def ranked_alignments(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.ranked_alignments(_length_tokens(words(spark, sf)), "ref", "hyp", 5).select(*UTT, "ranked")


def carried_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the words that were said on the words that were recognised."""
    w = words(spark, sf)
    labels = _listed(w.withColumn("l", F.col("idx").cast("string")), "l", "labels")
    found = alignment.relabelled(_length_tokens(w).join(labels, UTT), "ref", "hyp", "labels")
    return found.select(*UTT, F.concat_ws(",", F.transform("carried", lambda c: F.coalesce(c, F.lit("-")))).alias("carried"))


def timing_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and spread of the time since the word before, by boundary tag; negative times are filled from the label's past."""
    delta, _, _ = seq.timing_lags("start_ms", LINE, ["pos"])
    t = tagged(spark, sf).select(*LINE, "pos", F.substring(F.regexp_extract("gold", "<[ct]*/>", 0), 2, 1).alias("label"), F.when(F.col("pos") % 11 == 10, F.lit(-1)).otherwise(delta).alias("delta"))
    filled = t.withColumn("delta", seq.filled_negatives("delta", LINE, ["pos"], "label"))
    return filled.groupBy("label").agg(F.round(F.avg("delta"), 4).alias("mean"), F.round(F.stddev_pop("delta"), 4).alias("spread"), F.count(F.lit(1)).alias("n_words"))


def kl_conditional(spark: SparkSession, sf: str) -> DataFrame:
    """Divergence of users' from assistants' bigrams, by context."""
    along = Window.partitionBy(*UTT).orderBy("idx")
    n = words(spark, sf).withColumn("context", F.lag("word").over(along)).filter("context is not null").groupBy("speaker", "context", "word").agg(F.count(F.lit(1)).alias("n"))
    side = lambda s: n.filter(F.col("speaker") == s).select("context", "word", "n")
    return lm.conditional_divergence(side("user"), side("assistant"))


FOLDS = 10


def cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Ten trigram models, each scoring the tenth of the conversations that it has not seen."""
    scored = lm.cross_validated(_sentences(spark, sf), "conv_id", FOLDS, keep=lambda level: materialised(level, "folds"))
    lp = F.when(F.col("p") > 0, F.log2("p")).otherwise(0.0)
    return scored.groupBy("fold").agg(F.sum("n").alias("n_grams"), F.sum(F.when(F.col("p") == 0, F.col("n")).otherwise(0)).alias("n_unseen"), F.round(F.sum(F.col("n") * lp), 4).alias("logprob"))


def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """Two parallel lists in one shuffled order."""
    turns = table(spark, sf, "conversations", "conv_id", "turn", "role").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    return seq.seeded_order(turns, "key", 3).select("place", "key", "role")


def merged_clitics(spark: SparkSession, sf: str) -> DataFrame:
    """Clitics (every fifth word behind the first is taken for one) merged into the word before."""
    w = words(spark, sf)
    clitic = (F.col("idx") % 5 == 4) & (F.col("idx") > 0)
    pos = F.when(clitic, F.concat(F.lit("'"), F.substring("word", 1, 1))).otherwise(F.substring("word", 1, 2))
    said = w.groupBy(*UTT).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.when(clitic, F.concat(F.lit("'"), "word")).otherwise(F.col("word")).alias("word"), pos.alias("pos")))), lambda s: F.struct(s["word"].alias("word"), s["pos"].alias("pos"))).alias("said"))
    return said.select(*UTT, F.posexplode(text.merge_clitics(F.col("said"))).alias("at", "m")).select(*UTT, "at", "m.word", "m.pos")


def speaker_ages(spark: SparkSession, sf: str) -> DataFrame:
    """Ages at the time of talk in bands of ten years, and the share of each band, from a date ``yymmdd`` and a year of birth."""
    day = F.format_string("%02d0315", 85 + F.col("c_custkey") % 12)
    born = 1920 + F.col("c_custkey") * 7 % 55
    c = table(spark, sf, "customer", "c_custkey", "c_mktsegment").select("c_mktsegment", text.age_at(day, born).alias("age"))
    bands = c.groupBy("c_mktsegment", F.width_bucket("age", F.lit(10.0), F.lit(80.0), F.lit(7)).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("age").alias("youngest"))
    return bands.select("c_mktsegment", "band", "n", "youngest", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("c_mktsegment")), 6).alias("share"))


def act_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """How often each kind of event is, as a share of a user's events, in tenths, over users."""
    e = table(spark, sf, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))
    return e.withColumn("tenth", F.floor(share * 10).cast("int")).groupBy("event_type", "tenth").agg(F.count(F.lit(1)).alias("n_users"), F.sum("n").alias("n_events"))


def language_model_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a clean corpus written to files and read back for some dialogues only."""
    at = folder(spark, "lines")
    line = words(spark, sf).groupBy("conv_id", "speaker", "utt").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda s: s["word"])).alias("line"))
    ref = F.concat_ws(":", F.col("conv_id").cast("string"), F.upper(F.substring("speaker", 1, 1)), F.col("utt").cast("string"), F.lit("sv"))
    writers.write_text(line.select(ref.alias("utt_ref"), F.array(F.concat(ref, F.lit(","), F.regexp_replace("line", ",", "")), F.lit("POS,")).alias("lines")).select("utt_ref", F.concat_ws("\n", "lines").alias("value")), at, ["utt_ref"])
    ranges = table(spark, sf, "conversations", "conv_id").filter("conv_id % 3 = 0").select(F.col("conv_id").cast("string").alias("conv")).distinct()
    return readers.language_model_lines(spark, at, ranges).select("conv", "utt", F.md5("line").alias("line_md5"))


def trio(spark: SparkSession, sf: str) -> DataFrame:
    """Training, held-out and test corpora loaded together and encoded with one vocabulary."""
    at = folder(spark, "trio")
    part = F.when(F.col("conv_id") % 5 == 0, "test").when(F.col("conv_id") % 5 == 1, "heldout").otherwise("train")
    t = tagged(spark, sf).select(part.alias("part"), F.concat(F.col("conv_id").cast("string"), F.coalesce(F.substring("speaker", 1, 1), F.lit(""))).alias("speaker"), F.concat(F.lit("("), F.concat_ws(":", "utt", "utt", "idx"), F.lit(")")).alias("ref"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "word", F.lit("NN").alias("pos_tag"), F.col("gold").alias("tag"))
    writers.write_timed_corpora(t, at, readers.PARTS)
    paths = {name: f"{at}/part={name}" for name in readers.PARTS}
    vocabulary = writers.vocabulary(readers.timed_words(spark, paths["train"]), "word", min_count=2)
    loaded = readers.trio(spark, paths, vocabulary)
    unknown = vocabulary.filter("token = '<unk>'").first()["idx"]
    return loaded.groupBy("part").agg(F.count(F.lit(1)).alias("n_words"), F.sum((F.col("word_idx") == unknown).cast("long")).alias("n_unknown"), F.countDistinct("word_idx").alias("n_types"), F.sum((F.col("previous_word") == "").cast("long")).alias("n_first"))


def pos_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Maps from the words of an utterance to tags, written, read back and looked up; maps of the wrong length do not count."""
    at = folder(spark, "maps")
    w = words(spark, sf)
    listed = _listed(w.withColumn("p", F.when(F.length("word") > 3, "NN").otherwise("DT")), "p", "nodes")
    short = F.when(F.col("utt") % 4 == 3, F.slice("nodes", 1, F.size("nodes") - 1)).otherwise(F.col("nodes"))
    writers.write_text(writers.node_map(listed.select(F.concat_ws(":", "conv_id", "utt").alias("utt_ref"), short.alias("nodes"))), at, ["utt_ref"])
    found = readers.with_node_map(w.groupBy(*UTT).agg(F.max("n").alias("n")).withColumn("utt_ref", F.concat_ws(":", "conv_id", "utt")), readers.node_map(spark, at), "n")
    return found.select(*UTT, F.col("nodes").isNotNull().alias("fits"), F.size(F.filter(F.coalesce("nodes", F.array()), lambda x: x == "NN")).alias("n_nouns"))


QUERIES = {
    f.__name__: f
    for f in (
        scheme_variants, open_repairs, broken_repairs, retyped_repairs, interregna_before_onsets, cross_turn_repairs, best_paths, letter_times, common_runs, ranked_alignments, carried_labels, timing_by_label, kl_conditional, cross_validation, seeded_shuffle, merged_clitics, speaker_ages, act_frequencies,
        language_model_lines, trio, pos_maps,
    )
}

_BROKEN = """, br AS (SELECT conv_id, utt, idx, pos, word, repair_len, repair_type,
    CASE WHEN pos % 7 = 0 THEN regexp_replace(gold, '<rpn[a-z]* id=', '<rp id=', 'g') WHEN pos % 13 = 0 THEN regexp_replace(gold, '<rps id="[0-9]+"/>', '', 'g') ELSE gold END AS tag FROM tagged)"""
_PLACE = "regexp_extract(gold, '<[ct]*/>')"

ORACLES = {
    "scheme_variants": sql(
        TAGGED,
        f""", c AS (SELECT *, sum(CASE WHEN contains(gold, '<e/>') THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, utt ORDER BY idx) - CASE WHEN contains(gold, '<e/>') THEN 0 ELSE 1 END AS plain FROM tagged),
d AS (SELECT a.*, CASE WHEN a.repair_len > 0 THEN a.plain - b.plain END AS few FROM c a LEFT JOIN c b ON a.repair_len > 0 AND b.conv_id = a.conv_id AND b.utt = a.utt AND b.idx = a.idx - a.repair_len)
SELECT conv_id, utt, idx,
  CASE WHEN repair_len > 0 THEN '<rm-' || repair_len || '/>' || CASE WHEN repair_type = 'del' THEN '<rpEndDel/>' ELSE '<rpEndSub/>' END WHEN contains(gold, '<e/>') THEN '<e/>' ELSE '<f/>' END || {_PLACE}
    || '<diact type="' || speaker[1:2] || '"/>' || CASE WHEN pos % 19 = 0 THEN '<laughter/>' WHEN pos % 23 = 0 THEN '<speechLaugh/>' ELSE '<nolaughter/>' END AS "full",
  CASE WHEN repair_len > 0 THEN '<rm-' || CAST(few AS BIGINT) || '/>' || CASE WHEN repair_type = 'del' THEN '<rpEndDel/>' ELSE '<rpEndSub/>' END WHEN contains(gold, '<e/>') THEN '<e/>' ELSE '<f/>' END AS without_edits FROM d""",
    ),
    "open_repairs": sql(
        TAGGED + _BROKEN,
        """, o AS (SELECT conv_id, utt, idx, pos, repair_len, repair_type, word, regexp_replace(tag, '<rp id="([0-9]+)"/>', '', 'g') AS tag FROM br)
SELECT conv_id, utt, idx, CASE WHEN contains(tag, '<rps') AND NOT contains(tag, '<rpn') THEN regexp_replace(tag, '(<[ct]*/>)$', '') || '<rpn' || CASE WHEN repair_len = 1 THEN 'rep' ELSE 'sub' END || ' id="' || pos || '"/>' || regexp_extract(tag, '<[ct]*/>$') ELSE tag END AS tag
FROM o WHERE contains(tag, '<rpn') OR contains(tag, '<rps')""",
    ),
    "broken_repairs": sql(
        TAGGED + _BROKEN,
        """, a AS (SELECT conv_id, utt, regexp_extract(x, '<([a-z]+)', 1) AS kind, regexp_extract(x, 'id="([0-9]+)"', 1) AS id FROM (SELECT conv_id, utt, unnest(regexp_extract_all(tag, '<[a-z]+ id="[0-9]+"/>')) AS x FROM br)),
good AS (SELECT conv_id, utt, id FROM a GROUP BY 1, 2, 3 HAVING bool_or(kind = 'rms') AND bool_or(kind = 'rps') AND bool_or(starts_with(kind, 'rpn'))),
x AS (SELECT conv_id, utt, idx, unnest(regexp_extract_all(tag, '<.*?/>')) AS atom, unnest(range(len(regexp_extract_all(tag, '<.*?/>')))) AS nth FROM br),
k AS (SELECT x.* FROM x LEFT JOIN good g ON g.conv_id = x.conv_id AND g.utt = x.utt AND g.id = regexp_extract(x.atom, 'id="([0-9]+)"', 1) WHERE NOT contains(atom, 'id=') OR g.id IS NOT NULL),
s AS (SELECT conv_id, utt, idx, string_agg(atom, '' ORDER BY nth) AS tag FROM k GROUP BY 1, 2, 3)
SELECT conv_id, utt, idx, CASE WHEN regexp_full_match(tag, '<[ct]*/>') THEN '<f/>' || tag ELSE tag END AS tag FROM s""",
    ),
    "retyped_repairs": sql(TAGGED, "SELECT conv_id, utt, idx, CASE WHEN repair_len = 1 THEN regexp_replace(gold, '<rpnsub ', '<rpnrep ') ELSE gold END AS tag FROM tagged WHERE contains(gold, '<rpn')"),
    "interregna_before_onsets": sql(
        TAGGED,
        """, n AS (SELECT *, last_value(CASE WHEN NOT contains(gold, '<e') THEN regexp_extract(gold, '<rps id="([0-9]+)"/>', 1) END IGNORE NULLS) OVER (PARTITION BY conv_id, utt ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM tagged)
SELECT conv_id, utt, idx, '<i id="' || near || '"/>' || gold AS tag FROM n WHERE contains(gold, '<e') AND coalesce(near, '') <> ''""",
    ),
    "cross_turn_repairs": sql(
        WORDS,
        """, t AS (SELECT DISTINCT conv_id, speaker, utt FROM words), p AS (SELECT *, lag(utt) OVER (PARTITION BY conv_id, speaker ORDER BY utt) AS prev FROM t)
SELECT p.conv_id, p.speaker, p.utt, CAST(min(b.n - b.idx) AS INTEGER) AS back, a.word[1:2] AS word FROM p JOIN words a ON a.conv_id = p.conv_id AND a.utt = p.utt AND a.speaker = p.speaker AND a.idx = 0
JOIN words b ON b.conv_id = p.conv_id AND b.speaker = p.speaker AND b.utt = p.prev AND b.n - b.idx <= 3 AND b.word[1:2] = a.word[1:2] GROUP BY p.conv_id, p.speaker, p.utt, a.word""",
    ),
    "best_paths": _viterbi_ctes()
    + """,
fin AS (SELECT conv_id, utt, j, score, path, row_number() OVER (PARTITION BY conv_id, utt ORDER BY score DESC, j) - 1 AS rank FROM vit JOIN (SELECT conv_id, utt, max(idx) AS idx FROM e GROUP BY 1, 2) USING (conv_id, utt, idx))
SELECT conv_id, utt, CAST(rank AS INTEGER) AS rank, path, round(score, 6) AS score FROM fin WHERE rank < 3""",
    "letter_times": sql(
        WORDS,
        """, l AS (SELECT conv_id, utt, idx, word, min(start_ms) OVER u AS s, max(end_ms) OVER u + n AS e, sum(length(word)) OVER u AS every, sum(length(word)) OVER (PARTITION BY conv_id, utt ORDER BY idx) AS upto FROM words WINDOW u AS (PARTITION BY conv_id, utt))
SELECT conv_id, utt, idx, word, CAST(s + (e - s) * (upto - length(word)) // every AS BIGINT) AS start, CAST(s + (e - s) * upto // every AS BIGINT) AS "end" FROM l""",
    ),
    "timing_by_label": sql(
        TAGGED,
        f""", d AS (SELECT conv_id, speaker, pos, {_PLACE}[2:2] AS label, CASE WHEN pos % 11 = 10 THEN -1 ELSE coalesce(start_ms - lag(start_ms) OVER (PARTITION BY conv_id, speaker ORDER BY pos), 0) END AS delta FROM tagged),
f AS (SELECT label, CASE WHEN delta < 0 THEN coalesce(avg(CASE WHEN delta >= 0 THEN delta END) OVER (PARTITION BY conv_id, speaker, label ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE delta END AS delta FROM d)
SELECT label, round(avg(delta), 4) AS mean, round(stddev_pop(delta), 4) AS spread, count(*) AS n_words FROM f GROUP BY 1""",
    ),
    "kl_conditional": sql(
        WORDS,
        """, b AS (SELECT speaker, lag(word) OVER (PARTITION BY conv_id, utt ORDER BY idx) AS context, word FROM words), n AS (SELECT speaker, context, word, count(*) AS n FROM b WHERE context IS NOT NULL GROUP BY 1, 2, 3),
j AS (SELECT p.context, p.n AS np, q.n AS nq, sum(p.n) OVER c AS sp, sum(q.n) OVER c AS sq FROM n p JOIN n q ON p.context = q.context AND p.word = q.word WHERE p.speaker = 'user' AND q.speaker = 'assistant' WINDOW c AS (PARTITION BY p.context)),
k AS (SELECT context, sum(np / sp * log2((np / sp) / (nq / sq))) AS bits, max(sp) AS sp FROM j GROUP BY 1) SELECT round(sum(bits * sp) / sum(sp), 6) AS kl_bits, count(*) AS n_contexts FROM k""",
    ),
    "cross_validation": sql(
        WORDS,
        f""", r AS (SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) * {FOLDS} // count(*) OVER () AS fold FROM (SELECT DISTINCT conv_id FROM words)),
s AS (SELECT fold, conv_id, utt, ['<s>', '<s>'] || list(word ORDER BY idx) || ['</s>'] AS p FROM words JOIN r USING (conv_id) GROUP BY 1, 2, 3),
g AS (SELECT fold, p[i] AS a, p[i + 1] AS b, p[i + 2] AS c FROM (SELECT fold, p, unnest(range(1, len(p) - 1)) AS i FROM s)),
f AS (SELECT unnest(range({FOLDS})) AS m),
n3 AS (SELECT m, a, b, c, count(*) AS num FROM g JOIN f ON m <> fold GROUP BY 1, 2, 3, 4), n2 AS (SELECT m, b, c, count(*) AS num FROM n3 GROUP BY 1, 2, 3), n1 AS (SELECT m, c, count(*) AS num FROM n2 GROUP BY 1, 2),
c3 AS (SELECT m, a, b, CAST(sum(num) AS BIGINT) AS den, count(*) AS nz FROM n3 GROUP BY 1, 2, 3), c2 AS (SELECT m, b, CAST(sum(num) AS BIGINT) AS den, count(*) AS nz FROM n2 GROUP BY 1, 2), c1 AS (SELECT m, CAST(sum(num) AS BIGINT) AS den FROM n1 GROUP BY 1),
q AS (SELECT fold, coalesce(n1.num / c1.den, 0) AS p1, n2.num AS num2, c2.den AS den2, c2.nz AS nz2, n3.num AS num3, c3.den AS den3, c3.nz AS nz3 FROM g JOIN c1 ON c1.m = fold LEFT JOIN n1 ON n1.m = fold AND n1.c = g.c
  LEFT JOIN n2 ON n2.m = fold AND n2.b = g.b AND n2.c = g.c LEFT JOIN n3 ON n3.m = fold AND n3.a = g.a AND n3.b = g.b AND n3.c = g.c LEFT JOIN c2 ON c2.m = fold AND c2.b = g.b LEFT JOIN c3 ON c3.m = fold AND c3.a = g.a AND c3.b = g.b),
q2 AS (SELECT *, CASE WHEN den2 IS NULL THEN p1 ELSE CASE WHEN num2 > 0 THEN (num2 - 0.7) / den2 ELSE 0 END + nz2 * 0.7 / den2 * p1 END AS p2 FROM q),
q3 AS (SELECT fold, CASE WHEN den3 IS NULL THEN p2 ELSE CASE WHEN num3 > 0 THEN (num3 - 0.7) / den3 ELSE 0 END + nz3 * 0.7 / den3 * p2 END AS p FROM q2)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_grams, count(*) FILTER (WHERE p = 0) AS n_unseen, round(sum(CASE WHEN p > 0 THEN log2(p) ELSE 0 END), 4) AS logprob FROM q3 GROUP BY 1""",
    ),
    "seeded_shuffle": "SELECT row_number() OVER (ORDER BY md5('3:' || conv_id || '-' || turn)) - 1 AS place, conv_id || '-' || turn AS key, role FROM conversations",
    "merged_clitics": sql(
        WORDS,
        """, c AS (SELECT conv_id, utt, idx, idx % 5 = 4 AS clitic, CASE WHEN idx % 5 = 4 THEN chr(39) || word ELSE word END AS word, CASE WHEN idx % 5 = 4 THEN chr(39) || word[1:1] ELSE word[1:2] END AS pos FROM words),
g AS (SELECT *, sum(CASE WHEN clitic THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, utt ORDER BY idx) - 1 AS g FROM c)
SELECT conv_id, utt, CAST(g AS INTEGER) AS "at", string_agg(word, '' ORDER BY idx) AS word, string_agg(pos, '+' ORDER BY idx) AS pos FROM g GROUP BY conv_id, utt, g""",
    ),
    "speaker_ages": """WITH c AS (SELECT c_mktsegment, CAST(1985 + c_custkey % 12 - 1920 - c_custkey * 7 % 55 AS INTEGER) AS age FROM customer),
b AS (SELECT c_mktsegment, CAST(CASE WHEN age < 10 THEN 0 WHEN age >= 80 THEN 8 ELSE age // 10 END AS INTEGER) AS band, count(*) AS n, min(age) AS youngest FROM c GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY c_mktsegment), 6) AS share FROM b""",
    "act_frequencies": """WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT event_type, n, CAST(floor(n / sum(n) OVER (PARTITION BY user_id) * 10) AS INTEGER) AS tenth FROM e)
SELECT event_type, tenth, count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_events FROM s GROUP BY 1, 2""",
    "language_model_lines": sql(WORDS, "SELECT CAST(conv_id AS VARCHAR) AS conv, CAST(utt AS INTEGER) AS utt, md5(string_agg(word, ' ' ORDER BY idx)) AS line_md5 FROM words WHERE conv_id % 3 = 0 GROUP BY conv_id, utt"),
    "trio": sql(
        WORDS,
        """, t AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'test' WHEN conv_id % 5 = 1 THEN 'heldout' ELSE 'train' END AS part FROM words), v AS (SELECT word FROM t WHERE part = 'train' GROUP BY 1 HAVING count(*) >= 2)
SELECT part, count(*) AS n_words, count(*) FILTER (WHERE v.word IS NULL) AS n_unknown, count(DISTINCT coalesce(v.word, '<unk> ')) AS n_types, count(*) FILTER (WHERE pos = 0) AS n_first FROM t LEFT JOIN v USING (word) GROUP BY 1""",
    ),
    "pos_maps": sql(WORDS, "SELECT conv_id, utt, utt % 4 <> 3 AS fits, CAST(CASE WHEN utt % 4 <> 3 THEN count(*) FILTER (WHERE length(word) > 3) ELSE 0 END AS INTEGER) AS n_nouns FROM words GROUP BY 1, 2"),
}
ORACLES = {k: v.replace("\n, ", ",\n", 1) if v.startswith("WITH") else v for k, v in ORACLES.items()}
