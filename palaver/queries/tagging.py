"""Queries over single tags and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palaver.functions import tags, text
from palaver.operators import repairs
from palaver.operators.source_model import with_fluency

from .base import TAGGED, WORDS, sql, table, tagged, words

def utt_boundary_tags(spark: SparkSession, sf: str) -> DataFrame:
    utterance = Window.partitionBy("conv_id", "utt")
    first, last = F.col("idx") == F.min("idx").over(utterance), F.col("idx") == F.max("idx").over(utterance)
    return words(spark, sf).withColumn("boundary", tags.continuation(first, last)).groupBy("speaker", "boundary").agg(F.count(F.lit(1)).alias("n_words"))


def tag_atoms(spark: SparkSession, sf: str) -> DataFrame:
    found = tagged(spark, sf).select(F.explode(tags.atoms(F.col("gold"))).alias("atom"))
    return found.groupBy(F.regexp_replace("atom", "[0-9]+", "N").alias("atom")).agg(F.count(F.lit(1)).alias("n_atoms"))


def _incremental(spark: SparkSession, sf: str) -> DataFrame:
    """tagged with inc: the left-to-right form of gold."""
    return repairs.to_incremental(tagged(spark, sf))


# the SQL twin of the left-to-right form on the data at hand: every repair ends at its onset
_INC = """,
inc AS (SELECT *, CASE WHEN repair_len > 0 THEN '<rm-' || repair_len || '/>' || CASE WHEN repair_type = 'del' THEN '<rpEndDel/>' ELSE '<rpEndSub/>' END
    WHEN contains(gold, '<e/>') THEN '<e/>' ELSE '<f/>' END || regexp_extract(gold, '<[ct]*/>') AS inc FROM tagged)"""


def simple_labels(spark: SparkSession, sf: str) -> DataFrame:
    inc = _incremental(spark, sf)
    return inc.groupBy(tags.simple_label(F.col("inc"), uttseg=True).alias("label"), tags.simple_index(F.col("inc")).alias("label_idx"), tags.simple_label(F.col("inc")).alias("plain_label")).agg(F.count(F.lit(1)).alias("n_words"))


VOCABULARY = ("<e/>", "<f/>", "<rm-1/>", "<rm-2/>", "<rpEndSub/>", "<rpEndDel/>")


def full_tag_index(spark: SparkSession, sf: str) -> DataFrame:
    return _incremental(spark, sf).groupBy(tags.first_contained(F.col("inc"), VOCABULARY).alias("tag_idx"), tags.remove_uttseg(F.col("inc")).alias("tag")).agg(F.count(F.lit(1)).alias("n_words"))


def markov_states_simple(spark: SparkSession, sf: str) -> DataFrame:
    inc = _incremental(spark, sf)
    c = F.col("inc")
    return inc.groupBy(tags.simple_state(c).alias("state"), tags.simple_segment_state(c).alias("segment_state"), tags.segment_state(c).alias("boundary_state")).agg(F.count(F.lit(1)).alias("n_words"))


def markov_states_full(spark: SparkSession, sf: str) -> DataFrame:
    rows = _incremental(spark, sf).groupBy("conv_id", "utt").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "inc"))), lambda s: s["inc"]).alias("tags"))
    states = rows.select(F.explode(F.arrays_zip(tags.full_states(F.col("tags")).alias("plain"), tags.full_states(F.col("tags"), segments=True).alias("joint"))).alias("s"))
    return states.groupBy(F.col("s.plain").alias("state"), F.col("s.joint").alias("segment_state")).agg(F.count(F.lit(1)).alias("n_words"))


def act_states(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf)
    act = F.when(F.col("n") > 40, "sd").when(F.col("utt") % 2 == 0, "qy").otherwise("b^r/m")
    floor = F.when(F.col("idx") == 0, "take").otherwise("keep")
    tag = F.concat(F.lit('<diact type="'), act, F.lit('"/><speaker floor="'), floor, F.lit('"/>'), tags.continuation(F.col("idx") == 0, F.col("idx") == F.col("n") - 1))
    t = w.withColumn("t", tag)
    c = F.col("t")
    return t.groupBy(tags.dialogue_act(c).alias("act"), tags.act_segment_state(c).alias("act_segment"), tags.act_floor_state(c).alias("act_floor"), tags.act_floor_segment_state(c).alias("act_floor_segment")).agg(F.count(F.lit(1)).alias("n_words"))


def source_model_tags(spark: SparkSession, sf: str) -> DataFrame:
    found = with_fluency(_incremental(spark, sf).select("conv_id", "utt", "idx", "inc"), ["conv_id", "utt"], "idx", "inc")
    return found.select("conv_id", "utt", "idx", F.col("inc").alias("source_tag"))


def normalise_words(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "conversations", "text").select(F.explode(F.split("text", r"\s+")).alias("raw")).filter("raw <> ''")
    pos = F.when(F.length("raw") % 5 == 0, "NNP").otherwise("NN")
    known = F.length("raw") <= 9
    return raw.groupBy(text.strip_punctuation(F.col("raw")).alias("plain"), text.standardise_word(F.col("raw"), pos, known).alias("standard")).agg(F.count(F.lit(1)).alias("n_words"))


RULES = (("o+f", "uh"), ("d[ae]", "um"), ("the", "thuh"))


def word_forms(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf)
    c = F.col("word")
    spoken = F.when(F.length(c) == 3, "%HESITATION").when(F.length(c) == 4, "mmhm").otherwise(c)
    return w.select(
        text.normalise_orthography(c, RULES).alias("canonical"), text.clean_asr_word(spoken).alias("asr"), text.cleanup_symbols(F.concat(F.lit("<b>"), c, F.lit("-"))).alias("symbols"),
        text.clean_alignment_word(F.concat(F.lit("[laughter-"), c, F.lit("]"))).alias("aligned"), text.proper_prefix(F.substring(c, 1, 2), c).alias("has_prefix"), text.is_partial(c).alias("partial"),
    ).groupBy("canonical", "asr", "symbols", "aligned", "has_prefix", "partial").agg(F.count(F.lit(1)).alias("n_words"))


def clean_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "conversations", "conv_id", "turn", "text")
    return docs.select("conv_id", "turn", text.clean_transcript(F.concat(F.lit("{F "), F.col("text"), F.lit("} <<note>> #"))).alias("clean"))


def easy_read_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    t = tagged(spark, sf)
    token = t.select("conv_id", "utt", "idx", "gold", "word", text.easy_read_token(F.col("gold"), F.col("word")).alias("token"))
    back = token.select("*", text.easy_read_tag(F.col("token")).alias("tag"), text.easy_read_word(F.col("token")).alias("bare"))
    return back.groupBy("conv_id", "utt").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("idx", "token"))), lambda s: s["token"])).alias("line"), F.bool_and((F.col("tag") == F.col("gold")) & (F.col("bare") == F.col("word"))).alias("same"))


ACTS = ("qy^d", "sd^e", "qr", "fe", "co(^q)", "fx", "aap", "nd", "by", "nn^e", "ny^e", "b^m", "sv*", "x,y")


def damsl_collapse(spark: SparkSession, sf: str) -> DataFrame:
    acts = F.array(*map(F.lit, ACTS))
    e = table(spark, sf, "events", "event_id").select(F.get(acts, (F.col("event_id") % len(ACTS)).cast("int")).alias("act"))
    collapsed = text.collapse_act(F.col("act"))
    return e.groupBy("act", collapsed.alias("collapsed"), text.act_direction(collapsed, ("qy", "sd", "sv"), ("ba", "na", "ng")).alias("direction")).agg(F.count(F.lit(1)).alias("n_acts"))


def pos_pairs(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf)
    c5 = F.get(F.array(*map(F.lit, ("NN1", "VVB", "AJ0-NN1", "ZZZ"))), F.length("word") % 4)
    pair = w.withColumn("pair", F.concat("word", F.lit("/"), text.penn_from_c5(c5)))
    line = pair.groupBy("conv_id", "utt").agg(F.concat_ws("  ", F.transform(F.array_sort(F.collect_list(F.struct("idx", "pair"))), lambda s: s["pair"])).alias("line"))
    return line.select(F.explode(text.split_pos(F.col("line"))).alias("p")).groupBy(F.col("p.pos").alias("pos")).agg(F.count(F.lit(1)).alias("n_words"), F.countDistinct("p.word").alias("n_types"))


def utterance_ids(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf).filter("idx = 0")
    ref = F.concat_ws(":", F.col("conv_id").cast("string"), F.upper(F.substring("speaker", 1, 1)), F.col("utt").cast("string"), F.lit("sd"))
    p = text.utterance_parts(ref)
    r = text.word_ref(F.format_string("(%d:%d:%d)", F.col("utt"), F.col("utt") + 1, F.col("idx")))
    return w.select(p["conversation"].alias("conversation"), p["caller"].alias("caller"), p["utterance"].alias("utterance"), p["act"].alias("act"), (r["utterance"] + r["transcript"] + r["word"]).alias("ref_sum"))


def event_json(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events", "event_id", "props")
    return e.select("event_id", F.size(F.from_json(text.join_documents(F.concat("props", F.lit(" "), F.col("props"))), "array<map<string,string>>")).alias("n_objects"), F.element_at(text.int_list(F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(", 7]"))), -1).alias("last_int"))


def verify_tags(spark: SparkSession, sf: str) -> DataFrame:
    return repairs.verify(tagged(spark, sf).withColumn("tag", F.when((F.col("conv_id") * 31 + F.col("utt") * 7 + F.col("idx")) % 19 == 0, F.lit("<f/>")).otherwise(F.col("gold")))).select("conv_id", "utt", F.col("id").cast("long").alias("id"), "ok", "reason")


def eval_to_inc(spark: SparkSession, sf: str) -> DataFrame:
    return _incremental(spark, sf).groupBy("inc").agg(F.count(F.lit(1)).alias("n_words"))


def removed_repairs(spark: SparkSession, sf: str) -> DataFrame:
    t = tagged(spark, sf)
    ids = F.transform(F.filter(F.sequence(F.lit(0), F.lit(40)), lambda i: i % 3 == 0), lambda i: i.cast("string"))
    return t.withColumn("tag", tags.remove_repairs(tags.remove_uttseg(F.col("gold")), ids)).groupBy(F.regexp_replace("tag", "[0-9]+", "N").alias("tag")).agg(F.count(F.lit(1)).alias("n_words"))


SIMPLE = "', '".join(tags.SIMPLE_LABELS)
_LABEL = "CASE WHEN contains(inc, '<rm-') THEN '<rm-0/>' WHEN contains(inc, '<e') THEN '<e/>' ELSE '<f/>' END"
_STATE = "CASE WHEN contains(inc, '<f') THEN 'f' WHEN contains(inc, '<i') THEN 'i' WHEN contains(inc, '<e') THEN 'e' WHEN contains(inc, '<rm-') THEN 'rpSE' END"
_SEG = "CASE WHEN contains({0}, '<c') THEN 'c_' WHEN contains({0}, '<t') THEN 't_' END || {1} || CASE WHEN contains({0}, 'c/>') THEN '_c' WHEN contains({0}, 't/>') THEN '_t' END"
_VOCAB = " ".join(f"WHEN contains(inc, '{v}') THEN {i}" for i, v in enumerate(VOCABULARY))
_UNK = "CASE WHEN length(raw) % 5 = 0 THEN '$unc$' ELSE '' END || replace(lower(raw), '''', '')"
_DAMSL = "CASE act WHEN 'qy^d' THEN 'qy^d' WHEN 'sd^e' THEN 'sd' WHEN 'qr' THEN 'qy' WHEN 'fe' THEN 'ba' WHEN 'co(^q)' THEN 'oo_co_cc' WHEN 'fx' THEN 'sv' WHEN 'aap' THEN 'aap_am' WHEN 'nd' THEN 'arp_nd' WHEN 'by' THEN 'fo_o_fw_\"_by_bc' WHEN 'nn^e' THEN 'ng' WHEN 'ny^e' THEN 'na' WHEN 'b^m' THEN 'b^m' WHEN 'sv*' THEN 'sv' ELSE 'x' END"

QUERIES = {f.__name__: f for f in (utt_boundary_tags, tag_atoms, simple_labels, full_tag_index, markov_states_simple, markov_states_full, act_states, source_model_tags, normalise_words, word_forms, clean_transcripts, easy_read_round_trip, damsl_collapse, pos_pairs, utterance_ids, event_json, verify_tags, eval_to_inc, removed_repairs)}

ORACLES = {
    "utt_boundary_tags": sql(WORDS, "SELECT speaker, CASE WHEN idx = 0 THEN '<t' ELSE '<c' END || CASE WHEN idx = n - 1 THEN 't/>' ELSE 'c/>' END AS boundary, count(*) AS n_words FROM words GROUP BY 1, 2"),
    "tag_atoms": sql(TAGGED, "SELECT regexp_replace(a, '[0-9]+', 'N', 'g') AS atom, count(*) AS n_atoms FROM (SELECT unnest(regexp_extract_all(gold, '<.*?/>')) AS a FROM tagged) GROUP BY 1"),
    "simple_labels": sql(TAGGED + _INC, f"SELECT label, CASE WHEN list_position(['{SIMPLE}'], label) > 0 THEN list_position(['{SIMPLE}'], label) - 1 END AS label_idx, plain_label, count(*) AS n_words FROM (SELECT {_LABEL} AS plain_label, {_LABEL} || regexp_extract(inc, '<[ct]*/>') AS label FROM inc) GROUP BY ALL"),
    "full_tag_index": sql(TAGGED + _INC, f"SELECT CASE {_VOCAB} END AS tag_idx, regexp_replace(inc, '<[ct]*/>', '', 'g') AS tag, count(*) AS n_words FROM inc GROUP BY ALL"),
    "markov_states_simple": sql(TAGGED + _INC, f"SELECT {_STATE} AS state, {_SEG.format('inc', '(' + _STATE + ')')} AS segment_state, {_SEG.format('inc', chr(39) + 'w' + chr(39))} AS boundary_state, count(*) AS n_words FROM inc GROUP BY ALL"),
    "markov_states_full": sql(
        TAGGED + _INC,
        f"""SELECT state, {_SEG.format('inc', 'state')} AS segment_state, count(*) AS n_words
FROM (SELECT inc, CASE WHEN contains(inc, '<f') THEN 'f' WHEN contains(inc, '<e') THEN 'e' WHEN contains(inc, '<rpEnd') THEN 'rpSE' END AS state FROM inc) GROUP BY ALL""",
    ),
    "act_states": sql(
        WORDS,
        f"""SELECT act, {_SEG.format('seg', 'act')} AS act_segment, act || '_' || floor AS act_floor, {_SEG.format('seg', "act || '_' || floor")} AS act_floor_segment, count(*) AS n_words
FROM (SELECT CASE WHEN n > 40 THEN 'sd' WHEN utt % 2 = 0 THEN 'qy' ELSE 'b^r/m' END AS act, CASE WHEN idx = 0 THEN 'take' ELSE 'keep' END AS floor,
  CASE WHEN idx = 0 THEN '<t' ELSE '<c' END || CASE WHEN idx = n - 1 THEN 't/>' ELSE 'c/>' END AS seg FROM words) GROUP BY ALL""",
    ),
    "source_model_tags": sql(
        TAGGED + _INC,
        """SELECT a.conv_id, a.utt, a.idx, CASE WHEN contains(a.inc, '<e') OR EXISTS (SELECT 1 FROM inc b WHERE b.conv_id = a.conv_id AND b.utt = a.utt AND b.idx > a.idx AND b.repair_len > 0 AND b.idx - b.repair_len <= a.idx) THEN '<e/>'
  WHEN a.repair_len = 0 AND contains(a.inc, '<t') THEN '<s/>' ELSE '<f/>' END AS source_tag FROM inc a""",
    ),
    "normalise_words": f"""SELECT translate(lower(raw), ',.?()"''/', '') AS plain, CASE WHEN length(raw) <= 9 THEN {_UNK} ELSE '<unk>' END AS standard, count(*) AS n_words
FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS raw FROM conversations) WHERE raw <> '' GROUP BY ALL""",
    "word_forms": sql(
        WORDS,
        """SELECT CASE WHEN regexp_full_match(word, 'o+f') THEN 'uh' WHEN regexp_full_match(word, 'd[ae]') THEN 'um' WHEN word = 'the' THEN 'thuh' ELSE word END AS canonical,
  CASE length(word) WHEN 3 THEN 'uh' WHEN 4 THEN 'uh-huh' ELSE CASE WHEN word IN ('mmhm', 'aha', 'uhhuh') THEN 'uh-huh' ELSE word END END AS asr, regexp_replace(word, '[^a-z0-9'']', '', 'g') AS symbols, regexp_replace(word, '[\\[\\]{}]', '', 'g') AS aligned, length(word) > 2 AS has_prefix, word LIKE '%-' AS partial, count(*) AS n_words
FROM words GROUP BY ALL""",
    ),
    "clean_transcripts": """SELECT conv_id, turn, nullif(trim(regexp_replace(lower(regexp_replace(regexp_replace('{F ' || text || '} <<note>> #', '<[^>]*>|\\{[A-Z]|[{}\\[\\]+#]', ' ', 'g'), '[,.?!()"/]', '', 'g')), '\\s+', ' ', 'g')), '') AS clean FROM conversations""",
    "easy_read_round_trip": sql(TAGGED, "SELECT conv_id, utt, string_agg(replace(gold, ' ', '_') || word, ' ' ORDER BY idx) AS line, true AS same FROM tagged GROUP BY ALL"),
    "damsl_collapse": f"""SELECT act, collapsed, CASE WHEN collapsed IN ('qy', 'sd', 'sv') THEN 'f' WHEN collapsed IN ('ba', 'na', 'ng') THEN 'b' ELSE 'o' END AS direction, count(*) AS n_acts FROM (SELECT act, {_DAMSL} AS collapsed FROM (SELECT {list(ACTS)}[event_id % {len(ACTS)} + 1] AS act FROM events)) GROUP BY ALL""",
    "pos_pairs": sql(WORDS, "SELECT ['NN', 'VBP', 'JJ', 'ZZZ'][length(word) % 4 + 1] AS pos, count(*) AS n_words, count(DISTINCT word) AS n_types FROM words GROUP BY ALL"),
    "utterance_ids": sql(WORDS, "SELECT CAST(conv_id AS VARCHAR) AS conversation, upper(speaker[1]) AS caller, CAST(utt AS INTEGER) AS utterance, 'sd' AS act, CAST(2 * utt + 1 + idx AS INTEGER) AS ref_sum FROM words WHERE idx = 0"),
    "event_json": "SELECT event_id, 2 AS n_objects, 7 AS last_int FROM events",
    "verify_tags": sql(
        TAGGED,
        """, x AS (SELECT conv_id, utt, idx, CASE WHEN (conv_id * 31 + utt * 7 + idx) % 19 = 0 THEN '<f/>' ELSE gold END AS tag FROM tagged),
a AS (SELECT conv_id, utt, idx, unnest(regexp_extract_all(tag, '<(rms|rps|rpn)[a-z]* id="[0-9]+"/>', 0)) AS a FROM x),
b AS (SELECT conv_id, utt, CAST(regexp_extract(a, 'id="([0-9]+)"', 1) AS BIGINT) AS id, min(idx) FILTER (WHERE a LIKE '<rms%') AS rms, min(idx) FILTER (WHERE a LIKE '<rps%') AS rps, min(idx) FILTER (WHERE a LIKE '<rpn%') AS rpn FROM a GROUP BY 1, 2, 3)
SELECT conv_id, utt, id, rms IS NOT NULL AND rps IS NOT NULL AND rpn IS NOT NULL AS ok, CASE WHEN rms IS NULL THEN 'no reparandum start' WHEN rps IS NULL THEN 'no repair start' WHEN rpn IS NULL THEN 'no repair end' END AS reason FROM b""",
    ).replace("\n, x AS", ",\nx AS"),
    "eval_to_inc": sql(TAGGED + _INC, "SELECT inc, count(*) AS n_words FROM inc GROUP BY ALL"),
    "removed_repairs": sql(
        TAGGED,
        """SELECT regexp_replace(CASE WHEN left_over <> '' THEN left_over ELSE '<f/>' END, '[0-9]+', 'N', 'g') AS tag, count(*) AS n_words FROM (
  SELECT list_aggregate(list_filter(regexp_extract_all(regexp_replace(gold, '<[ct]*/>', '', 'g'), '<.*?/>'), lambda a: regexp_extract(a, 'id="([0-9]+)"', 1) = '' OR NOT (TRY_CAST(regexp_extract(a, 'id="([0-9]+)"', 1) AS INTEGER) <= 40 AND TRY_CAST(regexp_extract(a, 'id="([0-9]+)"', 1) AS INTEGER) % 3 = 0)), 'string_agg', '') AS left_over FROM tagged) GROUP BY ALL""",
    ),
}
