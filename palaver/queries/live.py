"""Queries over updates, sessions, trees, networks and file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palaver.functions import text
from palaver.operators import decoding, networks, repairs, source_model, trees
from palaver.sources import readers, writers
from palaver.streaming import tagger

from .base import TAGGED, WORDS, by_line, folder, materialised, sql, table, tagged, words
from .modelling import _model, pos_for_word

UTT = ["conv_id", "utt"]


def _timed(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "events", "ts", *columns).withColumn("ts", F.col("ts").cast("timestamp"))


def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = _timed(spark, sf, "event_id", "user_id").withColumn("at", F.unix_micros("ts") / 1e6)
    s = tagger.gap_sessions(e, ["user_id"], "at", 6 * 3600.0)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))


def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    w = tagger.windowed_counts(_timed(spark, sf, "event_type"), "ts", "1 hour", ["event_type"])
    return w.select(F.unix_seconds("window_start").alias("window_s"), "event_type", "n")


def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    s = tagger.session_counts(_timed(spark, sf, "user_id"), "ts", "6 hours", ["user_id"])
    return s.select("user_id", F.unix_micros("session_start").alias("start_us"), "n")


def _recognised(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events", "event_id", "user_id", "event_type")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    start = n * 100 - F.when(F.col("event_id") % 4 == 1, 120).when(F.col("event_id") % 4 == 2, 250).otherwise(0)
    return e.select("user_id", n.cast("long").alias("n"), F.col("event_type").alias("word"), start.cast("long").alias("start"), (start + 90).cast("long").alias("end"))


def events_prefix_diff(spark: SparkSession, sf: str) -> DataFrame:
    log = tagger.hypothesis_log(_recognised(spark, sf), "user_id", "n")
    return log.select(F.col("key").alias("user_id"), "update_no", "rollback", "length", "word")


def asr_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Recogniser messages as JSON, read back, with ids by the overlap rule: words, updates and repeats by user."""
    r = _recognised(spark, sf)
    stamp = F.array(F.col("word"), F.col("start").cast("string"), F.col("end").cast("string"))
    message = F.to_json(F.struct(F.floor(F.col("n") / 20).cast("int").alias("result_index"), F.array(F.struct(F.array(F.struct(F.array(stamp).alias("timestamps"))).alias("alternatives"))).alias("results")))
    read = readers.asr_messages(r.select("user_id", "n", message.alias("value")), key=["user_id", "n"])
    return tagger.hypothesis_ids(read, "user_id", "n").withColumnRenamed("key", "user_id")


LABELS = ["<f/><cc/>", "<f/><ct/>", "<f/><tc/>", "<f/><tt/>", "<e/><cc/>", "<e/><tc/>", "<rm-1/><rpEndSub/><cc/>", "<rm-2/><rpEndSub/><cc/>"]


def make_session() -> tagger.TaggingSession:
    """A tagging session with fixed arithmetic emissions."""

    def state_of(before: str, label: str) -> str:
        inner = "f" if "<f" in label else "e" if "<e" in label else "rpSE"
        return ("c_" if "<c" in label else "t_") + inner + ("_c" if "c/>" in label else "_t")

    def emit(said: list[str]) -> list[float]:
        n = len(said[-1])
        same = [len(said) > 1 and said[-1] == said[-2], len(said) > 2 and said[-1] == said[-3]]
        scores = [-((n * 7 + j * 5) % 11) / 2.0 for j in range(len(LABELS))]
        scores[6] += 4.0 if same[0] else -6.0
        scores[7] += 4.0 if same[1] else -6.0
        return scores

    return tagger.TaggingSession(LABELS, decoding.constraint_weights(), state_of, emit, simple=False)


def tag_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Updates of the users' words (each 6th one revokes a word and says it again, each 40th settles what was said, each 150th begins anew), replayed."""
    return tagger.replay(_updates(spark, sf), make_session)


def _updates(spark: SparkSession, sf: str) -> DataFrame:
    w = by_line(words(spark, sf))
    before = F.lag("word").over(Window.partitionBy("conv_id").orderBy("pos"))
    again = (F.col("pos") % 6 == 5) & before.isNotNull()
    return w.select(F.col("conv_id").cast("string").alias("key"), F.col("pos").alias("update_no"), F.when(again, 1).otherwise(0).alias("rollback"), F.when(again, F.array(before, F.col("word"))).otherwise(F.array("word")).alias("words"), F.when(F.col("pos") % 150 == 149, "reset").when(F.col("pos") % 40 == 39, "commit").alias("control"))


def tag_updates_final(spark: SparkSession, sf: str) -> DataFrame:
    return tagger.final_view(tagger.replay(_updates(spark, sf), make_session))


def arg_max_tags(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf).groupBy(*UTT).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda s: s["word"]).alias("words"))

    def run(batches):
        session = make_session()
        for pdf in batches:
            yield pdf[UTT].assign(tags=[" ".join(tagger.arg_max_tags(list(x), LABELS, session.emit)) for x in pdf["words"]])

    return w.mapInPandas(run, "conv_id long, utt long, tags string")


def _scored(spark: SparkSession, sf: str, of=lambda w: w) -> DataFrame:
    model, _ = _model(spark, sf, of=of)
    inc = of(repairs.to_incremental(tagged(spark, sf))).select(*UTT, "idx", "word", F.col("inc").alias("tag"))
    rows = source_model.known_words(source_model.with_fluency(inc, UTT, "idx"), model)
    return source_model.source_scores(materialised(rows, "spoken"), model, UTT, "idx")


def source_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Source model scores of all utterances with their repairs taken out; words that the model lacks are ``<unk>``."""
    return _scored(spark, sf).select(*UTT, F.round("source_score", 6).alias("source_score"), F.round("last_gain", 6).alias("last_gain"))


def source_scores_of_pos(spark: SparkSession, sf: str) -> DataFrame:
    """The same over POS tags, also by word."""
    return _scored(spark, sf, pos_for_word).select(*UTT, F.round("source_score", 6).alias("source_score"), F.round("per_word", 6).alias("per_word"))


def network_emissions(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf)
    features = F.array(F.length("word") / F.lit(10.0), F.col("idx") / F.lit(10.0), F.lit(1.0))
    seqs = w.groupBy(*UTT).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", features.alias("f")))), lambda s: s["f"]).alias("features"))
    out = networks.emissions(seqs, networks.random_elman(3, 8, 5, seed=3), UTT).select(*UTT, F.lit("elman").alias("net"), "emissions")
    out = out.unionByName(networks.emissions(seqs, networks.random_lstm(3, 8, 5, seed=4), UTT).select(*UTT, F.lit("lstm").alias("net"), "emissions"))
    return out.select(*UTT, "net", F.size("emissions").alias("n_steps"), F.round(F.get(F.element_at("emissions", -1), F.lit(0)), 6).alias("last_first"))


def timing_classifier(spark: SparkSession, sf: str) -> DataFrame:
    from palaver.operators.sequences import timing_lags

    d0, d1, d2 = timing_lags("start_ms", ["conv_id", "speaker"], ["pos"])
    rows = words(spark, sf).select((F.col("idx") == 0).cast("int").alias("label"), *(d.cast("double").alias(n) for d, n in ((d0, "d0"), (d1, "d1"), (d2, "d2"))))
    scaler, model = networks.fit_timing_classifier(rows)
    from pyspark.ml.feature import VectorAssembler

    scored = model.transform(scaler.transform(VectorAssembler(inputCols=["d0", "d1", "d2"], outputCol="raw").transform(rows)))
    return scored.groupBy("label", F.col("prediction").cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n_words"))


def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    s = words(spark, sf).groupBy(*UTT).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]).alias("tokens"))
    return networks.word_vectors(s).select("word")


def frequent_pos(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.element_at(F.array(*map(F.lit, ("NN", "VB", "JJ"))), (F.col("idx") % 3 + 1).cast("int"))
    t = networks.most_frequent_tagger(words(spark, sf).select("word", pos.alias("pos")))
    return t


def tree_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses made of the digits of numbers: ancestors, depths and path lengths."""
    digits = lambda c: F.transform(F.filter(F.split(c.cast("string"), ""), lambda d: d != ""), lambda d: d.cast("int"))
    e = table(spark, sf, "events", "event_id").select("event_id", digits(F.col("event_id")).alias("a"), digits(F.col("event_id") * 7 % 1000).alias("b"))
    labels = F.transform("a", lambda d: F.when(d % 4 == 0, "EDITED").otherwise("S"))
    return e.select(
        "event_id", trees.is_ancestor(F.col("b"), F.col("a")).alias("below"), F.size(trees.ancestors(F.col("a"))).alias("n_ancestors"), trees.depth(F.col("a"), labels).alias("depth"), trees.path_length(F.col("a"), F.col("b")).alias("path"), trees.is_edited(labels).alias("edited"),
        F.concat_ws(",", trees.edited_positions(F.transform("a", lambda d: d % 4 == 0)).cast("array<string>")).alias("edited_at"),
    )


def word_tree_pos(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf)
    leaf = F.when(F.col("idx") % 9 != 4, F.col("idx") - F.floor(F.col("idx") / 9).cast("int"))
    leaves = w.select(*UTT, F.col("idx").alias("leaf"), F.when(F.length("word") > 3, "NN").otherwise("DT").alias("pos"))
    return trees.word_pos(w.select(*UTT, "idx", leaf.alias("leaf")), leaves)


def format_round_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Every text format, written and read back; rows and equal rows by format."""
    at = folder(spark, "formats")
    ref = F.concat_ws(":", F.col("conv_id").cast("string"), F.upper(F.substring("speaker", 1, 1)), F.col("utt").cast("string"))
    t = tagged(spark, sf).select("*", ref.alias("utt_ref"), F.format_string("(%d:%d:%d)", F.col("utt"), F.col("utt"), F.col("idx")).alias("ref"), F.when(F.length("word") > 3, "NN").otherwise("DT").alias("pos_tag"), F.col("gold").alias("tag"))
    sid = F.concat(F.col("conv_id").cast("string"), F.substring("speaker", 1, 1))
    timed = t.select(sid.alias("speaker"), "ref", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "word", "pos_tag", "tag")
    log = t.select(sid.alias("speaker"), F.col("pos").alias("update_no"), (F.col("end_ms") / 1000).alias("update_time"), F.lit(0).alias("pos_in_update"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "word", "pos_tag", "tag")
    keys = {
        "detection": (writers.detection_corpus(t), ("utt_ref",), readers.detection_corpus, t, ["utt_ref", "ref", "word", "pos_tag", "tag"]),
        "timed": (writers.timed_corpus(timed), ("speaker",), lambda s, p: readers.timed_corpus(s, p, limit=False), timed, ["speaker", "ref", "start", "end", "word", "pos_tag", "tag"]),
        "increco": (writers.increco(log), ("speaker", "update_no"), readers.increco, log, ["speaker", "update_no", "update_time", "start", "end", "word", "pos_tag", "tag"]),
    }
    out = None
    for name, (blocks, (by, *within), read, before, columns) in keys.items():
        writers.write_text(blocks, f"{at}/{name}", [by], tuple(within))
        same = read(spark, f"{at}/{name}").select(*columns).exceptAll(before.select(*columns)).agg(F.count(F.lit(1)).alias("n_new"))
        row = before.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(same).select(F.lit(name).alias("format"), "n_rows", "n_new")
        out = row if out is None else out.unionByName(row)
    writers.write_text(writers.easy_read(t), f"{at}/easy", ["utt_ref"])
    back = readers.easy_read(spark, f"{at}/easy").select("utt_ref", F.explode(F.arrays_zip("words", "tags", "pos_tags", "refs")).alias("z")).select("utt_ref", "z.*")
    new = back.exceptAll(t.select("utt_ref", "word", "tag", "pos_tag", "ref")).agg(F.count(F.lit(1)).alias("n_new"))
    return out.unionByName(t.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(new).select(F.lit("easy").alias("format"), "n_rows", "n_new"))


def bracket_notation(spark: SparkSession, sf: str) -> DataFrame:
    """Whole utterances; in those of four or more words the second word is taken back and the third one put in its place."""
    said = F.regexp_replace("word", "[+{}]", "_")
    w = words(spark, sf).groupBy(*UTT).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", said.alias("word")))), lambda s: s["word"]).alias("w"))
    marked = F.transform("w", lambda x, i: F.when(i == 1, F.concat(F.lit("( "), x, F.lit(", + {F uh, }"))).when(i == 2, F.concat(x, F.lit(" )"))).otherwise(x))
    line = F.concat_ws(" ", F.when(F.size("w") >= 4, marked).otherwise(F.col("w")))
    return w.select(*UTT, F.posexplode(readers.bracketed(line)).alias("idx", "t")).select(*UTT, "idx", text.strip_punctuation(F.col("t.word")).alias("word"), "t.tag")


def vocabulary_file(spark: SparkSession, sf: str) -> DataFrame:
    return writers.vocabulary(words(spark, sf), "word", min_count=5)


def evaluation_file(spark: SparkSession, sf: str) -> DataFrame:
    return writers.evaluation_lines(tagged(spark, sf)).select(*UTT, F.md5("value").alias("value_md5"))


def annotation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Repair annotations written as lines and read back, with rows that do not fit marked."""
    at = folder(spark, "formats")
    t = tagged(spark, sf).filter("repair_len > 0")
    zero = F.lit("0")
    line = F.concat_ws("\t", F.col("conv_id").cast("string"), *(x.cast("string") for x in (F.col("utt"), F.col("idx") - F.col("repair_len"), F.col("utt"), F.col("idx"), F.col("utt"), F.col("idx"), F.col("utt"), F.col("idx") + 1)), zero, "repair_type")
    t.select(F.when(F.col("idx") % 10 == 0, "bad row").otherwise(F.concat(line, F.lit("\r"))).alias("value")).write.mode("overwrite").text(f"{at}/annotations")
    return readers.repair_annotations(spark, f"{at}/annotations").groupBy("ok", "type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("repair.word").alias("word_sum"))


QUERIES = {
    f.__name__: f
    for f in (
        gap_sessions, events_tumbling, session_windows, events_prefix_diff, asr_ids, tag_updates, tag_updates_final, arg_max_tags, source_scores, source_scores_of_pos, network_emissions, timing_classifier, word_vectors, frequent_pos, tree_paths, word_tree_pos, format_round_trips, bracket_notation, vocabulary_file, evaluation_file, annotation_rows,
    )
}

ORACLES = {
    "gap_sessions": """WITH a AS (SELECT *, CASE WHEN epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) > 21600 THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM a) SELECT user_id, session, count(*) AS n_events, min(event_id) AS first_event FROM s GROUP BY 1, 2""",
    "events_tumbling": "SELECT epoch_us(ts) // 3600000000 * 3600 AS window_s, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "session_windows": """WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 21600000000 THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a) SELECT user_id, min(epoch_us(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, g""",
    "events_prefix_diff": """WITH RECURSIVE r AS (SELECT user_id, event_type AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 4 AS m FROM events),
u AS (SELECT user_id, n, {'w': w, 's': n * 100 - CASE m WHEN 1 THEN 120 WHEN 2 THEN 250 ELSE 0 END, 'e': n * 100 - CASE m WHEN 1 THEN 120 WHEN 2 THEN 250 ELSE 0 END + 90} AS x FROM r),
f AS (
  SELECT user_id, n, [x] AS cur, 0 AS rollback, x.w AS word FROM u WHERE n = 1
  UNION ALL
  SELECT user_id, n, CASE WHEN same THEN cur ELSE kept || [x] END, CASE WHEN same THEN 0 ELSE len(cur) - len(kept) END, CASE WHEN same THEN NULL ELSE x.w END
  FROM (SELECT u.user_id, u.n, f.cur, u.x, list_filter(f.cur, lambda y: y.e <= u.x.s) AS kept, coalesce(f.cur[len(list_filter(f.cur, lambda y: y.e <= u.x.s)) + 1] = u.x, false) AS same FROM f JOIN u ON u.user_id = f.user_id AND u.n = f.n + 1))
SELECT user_id, n - 1 AS update_no, CAST(rollback AS INTEGER) AS rollback, CAST(len(cur) AS INTEGER) AS length, word FROM f""",
    "word_vectors": sql(WORDS, "SELECT word FROM words GROUP BY 1 HAVING count(*) >= 2"),
    "frequent_pos": sql(WORDS, ", n AS (SELECT word, ['NN', 'VB', 'JJ'][idx % 3 + 1] AS pos, count(*) AS n FROM words GROUP BY 1, 2) SELECT word, arg_min(pos, {'n': -n, 'pos': pos}) AS pos FROM n GROUP BY 1"),
    "tree_paths": """WITH e AS (SELECT event_id, list_transform(string_split(CAST(event_id AS VARCHAR), ''), lambda d: CAST(d AS INT)) AS a, list_transform(string_split(CAST(event_id * 7 % 1000 AS VARCHAR), ''), lambda d: CAST(d AS INT)) AS b FROM events)
SELECT event_id, len(b) < len(a) AND a[1:len(b)] = b AS below, CAST(len(a) AS INTEGER) AS n_ancestors, CAST(len(list_filter(a, lambda d: d % 4 <> 0)) AS INTEGER) AS depth,
  CAST(len(a) + len(b) - 2 * len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k])) AS INTEGER) AS path, len(list_filter(a, lambda d: d % 4 = 0)) > 0 AS edited,
  array_to_string(list_filter(range(len(a)), lambda i: a[i + 1] % 4 = 0), ',') AS edited_at FROM e""",
    "word_tree_pos": sql(WORDS, ", m AS (SELECT *, CASE WHEN idx % 9 <> 4 THEN idx - idx // 9 END AS leaf FROM words) SELECT m.conv_id, m.utt, m.idx, CASE WHEN l.word IS NULL THEN 'null' WHEN length(l.word) > 3 THEN 'NN' ELSE 'DT' END AS pos FROM m LEFT JOIN words l ON l.conv_id = m.conv_id AND l.utt = m.utt AND l.idx = m.leaf"),
    "format_round_trips": sql(WORDS, "SELECT f AS format, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_new FROM words, (VALUES ('detection'), ('timed'), ('increco'), ('easy')) v(f) GROUP BY 1"),
    "bracket_notation": sql(WORDS, """, x AS (SELECT conv_id, utt, idx, n, regexp_replace(word, '[+{}]', '_', 'g') AS word FROM words)
SELECT conv_id, utt, CASE WHEN n < 4 OR idx < 2 THEN idx ELSE idx + 1 END AS idx, word, CASE WHEN n < 4 THEN '<f/>' WHEN idx = 1 THEN '<rms id="1"/>' WHEN idx = 2 THEN '<rps id="1"/>' ELSE '<f/>' END AS tag FROM x
UNION ALL SELECT conv_id, utt, 2, 'uh', '<i id="1"/><e/>' FROM x WHERE idx = 0 AND n >= 4"""),
    "vocabulary_file": sql(WORDS, ", v AS (SELECT word FROM words GROUP BY 1 HAVING count(*) >= 5) SELECT row_number() OVER (ORDER BY encode(word)) - 1 AS idx, word AS token FROM v UNION ALL SELECT count(*), '<unk>' FROM v"),
    "evaluation_file": sql(TAGGED, "SELECT conv_id, utt, md5('BOS O O' || chr(10) || string_agg(word || ' ' || gold || ' ' || hyp, chr(10) ORDER BY idx) || chr(10) || 'EOS O O' || chr(10)) AS value_md5 FROM tagged GROUP BY 1, 2"),
    "annotation_rows": sql(TAGGED, "SELECT idx % 10 <> 0 AS ok, CASE WHEN idx % 10 <> 0 THEN repair_type END AS type, count(*) AS n_rows, CAST(sum(CASE WHEN idx % 10 <> 0 THEN idx END) AS BIGINT) AS word_sum FROM tagged WHERE repair_len > 0 GROUP BY 1, 2"),
}
ORACLES["asr_ids"] = """WITH RECURSIVE r AS (SELECT user_id, event_type AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 4 AS m FROM events),
u AS (SELECT user_id, n, n // 20 AS ri, n * 100 - CASE m WHEN 1 THEN 120 WHEN 2 THEN 250 ELSE 0 END AS s, w FROM r),
f AS (
  SELECT user_id, n, ri, [{'s': s, 'w': w, 'id': 0}] AS mem, 0 AS given, 1 AS next_id FROM u WHERE n = 1
  UNION ALL
  SELECT user_id, n, ri, CASE WHEN given IS NULL THEN mem ELSE kept || [{'s': s, 'w': w, 'id': given}] END, given, coalesce(given + 1, next_id)
  FROM (SELECT *, CASE WHEN len(list_filter(mem, lambda y: y.s = s AND y.w = w)) > 0 THEN NULL WHEN len(kept) = len(mem) THEN next_id ELSE mem[len(kept) + 1].id END AS given
    FROM (SELECT user_id, n, ri, s, w, next_id, mem, list_filter(mem, lambda y: y.s + 90 <= s) AS kept
      FROM (SELECT u.user_id, u.n, u.ri, u.s, u.w, f.next_id, CASE WHEN u.ri > f.ri THEN [] ELSE f.mem END AS mem FROM f JOIN u ON u.user_id = f.user_id AND u.n = f.n + 1))))
SELECT user_id, count(*) AS n_words, count(given) AS n_messages, CAST(max(given) + 1 AS BIGINT) AS n_ids FROM f GROUP BY 1"""
ORACLES["arg_max_tags"] = sql(
    WORDS,
    f""", w AS (SELECT conv_id, utt, idx, length(word) AS k, coalesce(word = lag(word, 1) OVER u, false) AS r1, coalesce(word = lag(word, 2) OVER u, false) AS r2 FROM words WINDOW u AS (PARTITION BY conv_id, utt ORDER BY idx)),
e AS (SELECT conv_id, utt, idx, j, -((k * 7 + j * 5) % 11) / 2.0::DOUBLE + CASE WHEN j = 6 THEN CASE WHEN r1 THEN 4 ELSE -6 END WHEN j = 7 THEN CASE WHEN r2 THEN 4 ELSE -6 END ELSE 0 END AS e FROM w, (SELECT unnest(range({len(LABELS)})) AS j)),
b AS (SELECT conv_id, utt, idx, -(max({{'e': e, 'j': -j}}).j) AS j FROM e GROUP BY 1, 2, 3)
SELECT conv_id, utt, string_agg(([{', '.join(f"'{x}'" for x in LABELS)}])[j + 1], ' ' ORDER BY idx) AS tags FROM b GROUP BY 1, 2""",
)
ORACLES = {k: v.replace("\n, ", ",\n", 1) if v.startswith("WITH") else v for k, v in ORACLES.items()}
