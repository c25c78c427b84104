"""Queries over language models, Markov models, decoding and alignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palaver.functions import tags
from palaver.operators import alignment, decoding, repairs
from palaver.operators import language_model as lm
from palaver.operators.sequences import with_rank

from .base import TAGGED, WORDS, materialised, sql, table, tagged, words

UTT = ["conv_id", "utt"]


def _sentences(spark: SparkSession, sf: str, of: Callable[[DataFrame], DataFrame] = lambda w: w) -> DataFrame:
    return of(words(spark, sf)).groupBy(*UTT).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda s: s["word"]).alias("tokens"))


def pos_for_word(w: DataFrame) -> DataFrame:
    """``w`` with a POS tag by arithmetic in place of each word."""
    return w.withColumn("word", F.concat(F.lit("P"), (F.length("word") % 5).cast("string")))


def _model(spark: SparkSession, sf: str, once: bool = False, of: Callable[[DataFrame], DataFrame] = lambda w: w) -> tuple[DataFrame, DataFrame]:
    """(model, test sentences): trained on most conversations, one fifth held out for the unknown word, one fifth for testing. Scoring reads the model several times, so it is
    written out unless it is read ``once``."""
    # read for the vocabulary, for training, for the unknown word and for testing
    s = materialised(_sentences(spark, sf, of), "sentences")
    train = s.filter("conv_id % 5 > 1")
    vocabulary = materialised(train.select(F.explode("tokens").alias("word")).distinct(), "words")
    model = lm.train(train.unionByName(lm.with_unknown(s.filter("conv_id % 5 = 1"), vocabulary, key=UTT)))
    return model if once else materialised(model, "model"), lm.with_unknown(s.filter("conv_id % 5 = 0"), vocabulary, key=UTT)


def _coded(spark: SparkSession, sf: str, of: Callable[[DataFrame], DataFrame] = lambda w: w) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(model, vocabulary, words): the model of ``_model`` with short codes in place of the words, for scores in which no word is named; what is shuffled for an n-gram is some bytes. A word of the training sentences has its rank as code, ``word`` and
    ``code`` in the vocabulary; start and end marks and the unknown word are coded as themselves. words: UTT, idx, place (in the sentence) and word, which is the code, ``?`` for one that is not in the vocabulary and ``?<s>`` for a start mark that is not."""
    s = materialised(of(words(spark, sf)).groupBy(*UTT).agg(F.array_sort(F.collect_list(F.struct("idx", "word"))).alias("w")), "sentences")
    counted = s.filter("conv_id % 5 > 1").select(F.explode("w.word").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = with_rank(materialised(counted.select("word", F.struct((-F.col("n")).alias("n"), "word").alias("key")), "counted"), "key")
    own = F.col("word").isin(lm.START, lm.END, lm.UNKNOWN)
    vocabulary = materialised(ranked.select("word", F.when(own, F.col("word")).otherwise(F.col("rank").cast("string")).alias("code")), "words")
    coded = materialised(with_codes(s.select(*UTT, F.posexplode("w").alias("place", "z")).select(*UTT, "place", "z.idx", "z.word"), vocabulary), "coded")
    known = F.when(F.col("word").startswith("?"), lm.UNKNOWN).otherwise(F.col("word"))
    # every fifth conversation is held out
    sentences = coded.filter("conv_id % 5 > 0").groupBy(*UTT).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", known.alias("t")))), lambda x: x["t"]).alias("tokens"))
    return materialised(lm.train(sentences), "model"), vocabulary, coded


def with_codes(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``rows`` with the codes of ``_coded`` in place of their words."""
    lacked = F.when(F.col("word").isin(lm.END, lm.UNKNOWN), F.col("word")).when(F.col("word") == lm.START, f"?{lm.START}").otherwise("?")
    return rows.join(vocabulary, "word", "left").withColumn("word", F.coalesce("code", lacked)).drop("code").select(*rows.columns)


def spoken_codes(coded: DataFrame) -> DataFrame:
    """Codes of words as they stand, in which a start mark is one whether or not the vocabulary has it."""
    return coded.select(*UTT, "idx", F.when(F.col("word") == f"?{lm.START}", lm.START).otherwise(F.col("word")).alias("word"))


def vocab_min_count(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


def most_frequent(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(25)


def label_union(spark: SparkSession, sf: str) -> DataFrame:
    t = tagged(spark, sf)
    kinds = lambda c: t.select(F.explode(tags.atoms(F.col(c))).alias("a")).select(F.regexp_replace("a", "[0-9]+", "N").alias("label"))
    return kinds("gold").union(kinds("hyp")).distinct()


def clean_corpus(spark: SparkSession, sf: str) -> DataFrame:
    kept = tagged(spark, sf).filter(~(F.col("gold").contains("<e") | F.col("gold").contains("<rm") | F.col("gold").contains("<i")))
    return kept.groupBy(*UTT).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda s: s["word"])).alias("line"))


def tag_corpus(spark: SparkSession, sf: str) -> DataFrame:
    inc = repairs.to_incremental(tagged(spark, sf))
    return inc.groupBy(*UTT).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("idx", "inc"))), lambda s: s["inc"])).alias("line"))


def ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lm.all_ngram_counts(_sentences(spark, sf), 3).filter("n > 1").withColumnRenamed("order", "n_order")


def kn_counts(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = _model(spark, sf, once=True)
    return model.select(F.col("order").alias("n_order"), "context", "word", "num", "den", "nz")


def kn_prob(spark: SparkSession, sf: str) -> DataFrame:
    model, test = _model(spark, sf)
    p = lm.probabilities(lm.ngrams(test, 3, key=UTT), model)
    return p.select(*UTT, "at", F.round("p", 9).alias("p"), F.round("p1", 9).alias("p1"))


def sent_logprob(spark: SparkSession, sf: str) -> DataFrame:
    model, test = _model(spark, sf)
    return lm.sentence_scores(lm.probabilities(lm.ngrams(test, 3, key=UTT), model), UTT)


def entropy_cont(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = _model(spark, sf)
    return lm.continuation_entropy(model.filter(F.col("order") == 3).select("context"), model)


def information_gain(spark: SparkSession, sf: str) -> DataFrame:
    h = entropy_cont(spark, sf)
    return h.select("context", F.round(lm.information_gain(F.lit(3.0), F.col("entropy")), 6).alias("gain"), F.round(lm.partial_word_probability(F.col("seen_mass"), F.col("n_seen") % 2 == 0), 9).alias("partial"), F.round(lm.completion_probability(F.col("seen_mass")), 9).alias("completed"))


def kl_pair(spark: SparkSession, sf: str) -> DataFrame:
    n = words(spark, sf).groupBy("speaker", "word").agg(F.count(F.lit(1)).alias("n"))
    side = lambda s: n.filter(F.col("speaker") == s).select("word", "n")
    smooth = lm.kl_divergence(side("user"), side("assistant")).select(F.lit("smoothed").alias("kind"), "*")
    return smooth.unionByName(lm.kl_divergence(side("user"), side("assistant"), 0.0).select(F.lit("shared words").alias("kind"), "*"))


def prefix_sums(spark: SparkSession, sf: str) -> DataFrame:
    model, test = _model(spark, sf)
    sums = lm.prefix_sums(lm.probabilities(lm.ngrams(test, 3, key=UTT), model), UTT, "at")
    return lm.span_scores(sums, UTT, "at", 4).select(*UTT, "at", F.round("span_logprob", 6).alias("span_logprob"), F.round("span_logprob1", 6).alias("span_logprob1"))


def excision_features(spark: SparkSession, sf: str) -> DataFrame:
    model, _, coded = _coded(spark, sf)
    return lm.excision_features(spoken_codes(coded), model, UTT, "idx").select(*UTT, "idx", "boost")


def _states(spark: SparkSession, sf: str) -> DataFrame:
    inc = repairs.to_incremental(tagged(spark, sf))
    return inc.select("conv_id", "speaker", "pos", tags.simple_segment_state(F.col("inc")).alias("state"))


def transition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return decoding.transition_counts(_states(spark, sf), ["conv_id", "speaker"], "pos")


def transition_probs(spark: SparkSession, sf: str) -> DataFrame:
    counts = decoding.transition_counts(_states(spark, sf), ["conv_id", "speaker"], "pos")
    return decoding.transition_probabilities(counts).select("prev", "next", F.round("p", 6).alias("p"))


def interregnum_states(spark: SparkSession, sf: str) -> DataFrame:
    return decoding.interregna(_states(spark, sf), ["conv_id", "speaker"], "pos").groupBy("state").agg(F.count(F.lit(1)).alias("n_words"))


def constraint_table(spark: SparkSession, sf: str) -> DataFrame:
    wide = spark.createDataFrame([(p, *(int(n in ns) for n in decoding.STATES)) for p, ns in decoding.MAY_FOLLOW.items()], "prev string, " + ", ".join(f"{s} int" for s in decoding.STATES))
    counts = decoding.matrix_to_counts(wide)
    seen = decoding.transition_counts(_states(spark, sf), ["conv_id", "speaker"], "pos", with_end=False)
    return seen.join(counts.select("prev", "next", F.lit(True).alias("allowed")), ["prev", "next"], "left").select("prev", "next", "n", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    counts = decoding.transition_counts(_states(spark, sf), ["conv_id", "speaker"], "pos", with_end=False)
    return decoding.counts_to_matrix(counts, list(decoding.STATES))


def training_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with at least one repair, as sparse training keeps them."""
    return tag_corpus(spark, sf).filter(F.col("line").contains("<r"))


def _emissions(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf)
    score = lambda j: (-((F.length("word") * 7 + F.col("idx") * 3 + F.lit(j * 5)) % 11) / F.lit(2.0)).cast("double")
    return w.withColumn("e", F.array(*(score(j) for j in range(len(decoding.STATES)))))


def viterbi_short(spark: SparkSession, sf: str) -> DataFrame:
    rows = _emissions(spark, sf).groupBy(*UTT).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "e"))), lambda s: s["e"]).alias("emissions"))
    found = decoding.viterbi(rows, list(decoding.STATES), decoding.constraint_weights())
    return found.select(*UTT, F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"), F.round("score", 6).alias("score"))


def viterbi_with_end(spark: SparkSession, sf: str) -> DataFrame:
    rows = _emissions(spark, sf).groupBy(*UTT).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "e"))), lambda s: s["e"]).alias("emissions"))
    ends = {s: 0.0 for s in decoding.STATES if s.endswith("_t")}
    found = decoding.viterbi(rows, list(decoding.STATES), decoding.constraint_weights(), end_weights=ends)
    return found.select(*UTT, F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"), F.round("score", 6).alias("score"))


def argmax_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _emissions(spark, sf).select(*UTT, "idx", decoding.argmax_label(F.col("e")).cast("int").alias("label_idx"))


def _length_tokens(w: DataFrame) -> DataFrame:
    w = w.withColumn("t", F.char(F.length("word") % 26 + 97))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["t"])
    hyp = F.when(F.col("idx") % 7 != 3, F.struct("idx", F.when(F.col("idx") % 5 == 1, F.lit("z")).otherwise(F.col("t")).alias("t")))
    return w.groupBy(*UTT).agg(ordered(F.struct("idx", "t")).alias("ref"), ordered(hyp).alias("hyp"))


def token_wer(spark: SparkSession, sf: str) -> DataFrame:
    found = alignment.distances(_length_tokens(words(spark, sf)), "ref", "hyp")
    return found.select(*UTT, "distance", F.round("wer", 6).alias("wer"))


def word_alignments(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.alignments(_length_tokens(words(spark, sf)), "ref", "hyp").select(*UTT, "alignment", "cost")


def repair_classes(spark: SparkSession, sf: str) -> DataFrame:
    t = repairs.repair_table(tagged(spark, sf), "gold")
    pairs = lambda c: F.transform(F.split(c, " "), lambda w: F.struct(w.alias("word"), F.when(F.length(w) > 3, "NN").otherwise("IN").alias("pos")))
    return alignment.repair_classes(t.select(*UTT, "id", pairs("reparandum").alias("a"), pairs("repair").alias("b")), "a", "b")


QUERIES = {
    f.__name__: f
    for f in (
        vocab_min_count, most_frequent, label_union, clean_corpus, tag_corpus, ngram_counts, kn_counts, kn_prob, sent_logprob, entropy_cont, information_gain, kl_pair, prefix_sums, excision_features, transition_counts, transition_probs, interregnum_states, constraint_table,
        transition_matrix, training_filter, viterbi_short, viterbi_with_end, argmax_labels, token_wer, word_alignments, repair_classes,
    )
}

_MODEL = (
    WORDS
    + """,
v AS (SELECT DISTINCT word FROM words WHERE conv_id % 5 > 1),
x AS (SELECT conv_id, utt, idx, CASE WHEN conv_id % 5 > 1 OR v.word IS NOT NULL THEN words.word ELSE '<unk>' END AS t FROM words LEFT JOIN v ON words.word = v.word),
s AS (SELECT conv_id, utt, ['<s>', '<s>'] || list(t ORDER BY idx) || ['</s>'] AS p FROM x GROUP BY 1, 2),
g AS (SELECT conv_id, utt, i, p[i] AS a, p[i + 1] AS b, p[i + 2] AS c FROM (SELECT conv_id, utt, p, unnest(range(1, len(p) - 1)) AS i FROM s)),
n3 AS (SELECT a, b, c, count(*) AS num FROM g WHERE conv_id % 5 > 0 GROUP BY 1, 2, 3),
n2 AS (SELECT b, c, count(*) AS num FROM n3 GROUP BY 1, 2),
n1 AS (SELECT c, count(*) AS num FROM n2 GROUP BY 1),
c3 AS (SELECT a, b, CAST(sum(num) AS BIGINT) AS den, count(*) AS nz FROM n3 GROUP BY 1, 2),
c2 AS (SELECT b, CAST(sum(num) AS BIGINT) AS den, count(*) AS nz FROM n2 GROUP BY 1),
c1 AS (SELECT CAST(sum(num) AS BIGINT) AS den, count(*) AS nz FROM n1),
q AS (SELECT {keys}, coalesce(n1.num / (SELECT den FROM c1), 0) AS p1,
    CASE WHEN c2.den IS NULL THEN coalesce(n1.num / (SELECT den FROM c1), 0) ELSE CASE WHEN n2.num > 0 THEN (n2.num - 0.7) / c2.den ELSE 0 END + (c2.nz * 0.7 / c2.den) * coalesce(n1.num / (SELECT den FROM c1), 0) END AS p2,
    n3.num AS num3, c3.den AS den3, c3.nz AS nz3
  FROM {rows} r LEFT JOIN n1 ON n1.c = r.c LEFT JOIN n2 ON n2.b = r.b AND n2.c = r.c LEFT JOIN n3 ON n3.a = r.a AND n3.b = r.b AND n3.c = r.c LEFT JOIN c2 ON c2.b = r.b LEFT JOIN c3 ON c3.a = r.a AND c3.b = r.b),
prob AS (SELECT *, CASE WHEN den3 IS NULL THEN p2 ELSE CASE WHEN num3 > 0 THEN (num3 - 0.7) / den3 ELSE 0 END + (nz3 * 0.7 / den3) * p2 END AS p FROM q)"""
)
_TEST = _MODEL.replace("{keys}", "r.conv_id, r.utt, r.i - 1 AS \"at\"").replace("{rows}", "(SELECT * FROM g WHERE conv_id % 5 = 0)")
_SEEN = _MODEL.replace("{keys}", "r.a || ' ' || r.b AS context").replace("{rows}", "n3")
_LP = ", lp AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE log2(p) END AS lp, CASE WHEN p1 = 0 THEN 0 ELSE log2(p1) END AS lp1 FROM prob)"
_ENTROPY = ", h AS (SELECT context, sum(CASE WHEN p = 0 THEN 0 ELSE -p * log2(p) END) AS h, sum(p) AS mass, count(*) AS n, (SELECT nz FROM c1) AS v FROM prob GROUP BY 1), ent AS (SELECT context, round(h + CASE WHEN v - n > 0 AND 1 - mass > 0 THEN -(1 - mass) * log2((1 - mass) / (v - n)) ELSE 0 END, 6) AS entropy, round(mass, 6) AS seen_mass, n AS n_seen FROM h)"
_INC = """, inc AS (SELECT *, CASE WHEN repair_len > 0 THEN '<rm-' || repair_len || '/>' || CASE WHEN repair_type = 'del' THEN '<rpEndDel/>' ELSE '<rpEndSub/>' END
    WHEN contains(gold, '<e/>') THEN '<e/>' ELSE '<f/>' END || regexp_extract(gold, '<[ct]*/>') AS inc FROM tagged),
st AS (SELECT conv_id, speaker, pos, CASE WHEN contains(inc, '<c') THEN 'c_' ELSE 't_' END || CASE WHEN contains(inc, '<f') THEN 'f' WHEN contains(inc, '<e') THEN 'e' ELSE 'rpSE' END || CASE WHEN contains(inc, 'c/>') THEN '_c' ELSE '_t' END AS state FROM inc),
tr AS (SELECT coalesce(lag(state) OVER w, 's') AS prev, state AS next FROM st WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY pos)),
tre AS (SELECT * FROM tr UNION ALL SELECT state, 'se' FROM (SELECT state, lead(state) OVER (PARTITION BY conv_id, speaker ORDER BY pos) AS nx FROM st) WHERE nx IS NULL)"""
_ALLOWED = "(VALUES " + ", ".join(f"('{p}', '{n}')" for p, ns in decoding.MAY_FOLLOW.items() for n in ns) + ") m(prev, next)"


def _viterbi_ctes() -> str:
    """Viterbi columns of whole utterances: vit(conv_id, utt, idx, j, score, path)."""
    index = {s: j for j, s in enumerate(decoding.STATES)} | {"s": -1}
    weights = "(VALUES " + ", ".join(f"({index[p]}, {index[q]}, {w!r}::DOUBLE)" for (p, q), w in decoding.constraint_weights().items()) + ") t(i, j, w)"
    return f"""WITH RECURSIVE {WORDS.strip()},
e AS (SELECT conv_id, utt, idx, j, -((length(word) * 7 + idx * 3 + j * 5) % 11) / 2.0::DOUBLE AS e FROM words, (SELECT unnest(range({len(decoding.STATES)})) AS j)),
tw AS (SELECT * FROM {weights}),
vit AS (
  SELECT e.conv_id, e.utt, e.idx, e.j, tw.w + e.e AS score, CAST(e.j AS VARCHAR) AS path FROM e JOIN tw ON tw.i = -1 AND tw.j = e.j WHERE e.idx = 0
  UNION ALL
  SELECT conv_id, utt, idx, j, b.score, b.path || ',' || CAST(j AS VARCHAR) FROM (
    SELECT e.conv_id, e.utt, e.idx, e.j, max({{'score': v.score + tw.w + e.e, 'i': -v.j, 'path': v.path}}) AS b
    FROM vit v JOIN tw ON tw.i = v.j JOIN e ON e.conv_id = v.conv_id AND e.utt = v.utt AND e.idx = v.idx + 1 AND e.j = tw.j GROUP BY 1, 2, 3, 4))"""


def _viterbi_sql(end: bool) -> str:
    allowed_end = "(" + ", ".join(str(j) for j, s in enumerate(decoding.STATES) if s.endswith("_t")) + ")"
    final = f"AND j IN {allowed_end}" if end else ""
    return f"""{_viterbi_ctes()},
fin AS (SELECT conv_id, utt, max({{'score': score, 'j': -j, 'path': path}}) AS b FROM vit JOIN (SELECT conv_id, utt, max(idx) AS idx FROM e GROUP BY 1, 2) USING (conv_id, utt, idx) WHERE true {final} GROUP BY 1, 2)
SELECT conv_id, utt, b.path AS path, round(b.score, 6) AS score FROM fin"""


_REF = ", r AS (SELECT conv_id, utt, string_agg(chr(CAST(length(word) % 26 + 97 AS INTEGER)), '' ORDER BY idx) AS ref, coalesce(string_agg(CASE WHEN idx % 5 = 1 THEN 'z' ELSE chr(CAST(length(word) % 26 + 97 AS INTEGER)) END, '' ORDER BY idx) FILTER (WHERE idx % 7 <> 3), '') AS hyp FROM words GROUP BY 1, 2)"

ORACLES = {
    "vocab_min_count": sql(WORDS, "SELECT word, count(*) AS n FROM words GROUP BY 1 HAVING count(*) >= 3"),
    "most_frequent": sql(WORDS, "SELECT word, count(*) AS n FROM words GROUP BY 1 ORDER BY n DESC, encode(word) LIMIT 25"),
    "label_union": sql(TAGGED, "SELECT DISTINCT regexp_replace(a, '[0-9]+', 'N', 'g') AS label FROM (SELECT unnest(regexp_extract_all(gold, '<.*?/>')) AS a FROM tagged UNION ALL SELECT unnest(regexp_extract_all(hyp, '<.*?/>')) FROM tagged)"),
    "clean_corpus": sql(TAGGED, "SELECT conv_id, utt, string_agg(word, ' ' ORDER BY idx) AS line FROM tagged WHERE NOT (contains(gold, '<e') OR contains(gold, '<rm') OR contains(gold, '<i')) GROUP BY 1, 2"),
    "tag_corpus": sql(TAGGED + _INC, "SELECT conv_id, utt, string_agg(inc, ',' ORDER BY idx) AS line FROM inc GROUP BY 1, 2"),
    "training_filter": sql(TAGGED + _INC, "SELECT conv_id, utt, string_agg(inc, ',' ORDER BY idx) AS line FROM inc GROUP BY 1, 2 HAVING contains(string_agg(inc, ','), '<r')"),
    "ngram_counts": sql(WORDS, ", l AS (SELECT conv_id, utt, list(word ORDER BY idx) AS t FROM words GROUP BY 1, 2), o AS (SELECT d, t, unnest(range(1, len(t) - d + 2)) AS i FROM l, (VALUES (1), (2), (3)) v(d) WHERE len(t) >= d) SELECT d AS n_order, array_to_string(t[i:i + d - 1], ' ') AS gram, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(*) > 1"),
    "kn_counts": sql(_TEST, ", z AS (SELECT 3 AS n_order, a || ' ' || b AS context, c AS word, num, den, nz FROM n3 JOIN c3 USING (a, b) UNION ALL SELECT 2, b, c, num, den, nz FROM n2 JOIN c2 USING (b) UNION ALL SELECT 1, '', c, num, den, nz FROM n1, c1) SELECT * FROM z"),
    "kn_prob": sql(_TEST, "SELECT conv_id, utt, \"at\", round(p, 9) AS p, round(p1, 9) AS p1 FROM prob"),
    "sent_logprob": sql(
        _TEST + _LP,
        """SELECT conv_id, utt, round(sum(lp), 6) AS logprob, round(-sum(lp), 6) AS surprisal, round(-sum(p * lp), 6) AS weighted_surprisal, round(-sum(lp) / count(*), 6) AS cross_entropy, round(pow(2, -sum(lp) / count(*)), 6) AS perplexity, round(sum(lp) / count(*), 6) AS mean_logprob,
  round(CASE WHEN sum(lp1) = 0 THEN 0 ELSE sum(lp) / -sum(lp1) END, 6) AS wml, round(min(CASE WHEN lp1 = 0 THEN 0 ELSE lp / -lp1 END), 6) AS min_ratio, round(max(CASE WHEN lp1 = 0 THEN 0 ELSE lp / -lp1 END), 6) AS max_ratio, round(list_aggregate(list_sort(list(lp))[1:3], 'avg'), 6) AS mean_of_smallest FROM lp GROUP BY 1, 2""",
    ),
    "entropy_cont": sql(_SEEN + _ENTROPY, "SELECT * FROM ent"),
    "information_gain": sql(_SEEN + _ENTROPY, "SELECT context, round(CASE WHEN entropy > 0 THEN log2(3.0 / entropy) ELSE 0 END, 6) AS gain, round(CASE WHEN n_seen % 2 = 0 THEN seen_mass * 1e-5 ELSE seen_mass END, 9) AS partial, round(seen_mass * 0.075, 9) AS completed FROM ent"),
    "kl_pair": sql(
        WORDS,
        """, p AS (SELECT word, count(*) AS n FROM words WHERE speaker = 'user' GROUP BY 1), q AS (SELECT word, count(*) AS n FROM words WHERE speaker = 'assistant' GROUP BY 1),
b AS (SELECT 'smoothed' AS kind, coalesce(p.n, 0) + 1 AS np, coalesce(q.n, 0) + 1 AS nq FROM p FULL JOIN q USING (word) UNION ALL SELECT 'shared words', p.n, q.n FROM p JOIN q USING (word)),
z AS (SELECT kind, np / sum(np) OVER (PARTITION BY kind) AS x, nq / sum(nq) OVER (PARTITION BY kind) AS y FROM b)
SELECT kind, round(sum(x * log2(x / y)), 6) AS kl_bits, count(*) AS n_words FROM z GROUP BY 1""",
    ),
    "prefix_sums": sql(_TEST + _LP, "SELECT conv_id, utt, \"at\", round(sum(lp) OVER w, 6) AS span_logprob, round(sum(lp1) OVER w, 6) AS span_logprob1 FROM lp WINDOW w AS (PARTITION BY conv_id, utt ORDER BY \"at\" ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"),
    "transition_counts": sql(TAGGED + _INC, "SELECT prev, next, count(*) AS n FROM tre GROUP BY 1, 2"),
    "transition_probs": sql(TAGGED + _INC, "SELECT prev, next, round(count(*) / sum(count(*)) OVER (PARTITION BY prev), 6) AS p FROM tre GROUP BY 1, 2"),
    "interregnum_states": sql(
        TAGGED + _INC,
        """, f AS (SELECT *, last_value(CASE WHEN NOT regexp_matches(state, '(^|_)e(_|$)') THEN state END IGNORE NULLS) OVER (PARTITION BY conv_id, speaker ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nxt FROM st)
SELECT CASE WHEN regexp_matches(state, '(^|_)e(_|$)') AND coalesce(contains(nxt, 'rpS'), false) THEN replace(state, '_e_', '_i_') ELSE state END AS state, count(*) AS n_words FROM f GROUP BY 1""",
    ),
    "constraint_table": sql(TAGGED + _INC, f", n AS (SELECT prev, next, count(*) AS n FROM tr GROUP BY 1, 2) SELECT prev, next, n, (prev, next) IN (SELECT (prev, next) FROM {_ALLOWED}) AS allowed FROM n"),
    "transition_matrix": sql(TAGGED + _INC, "SELECT prev, " + ", ".join(f"nullif(count(*) FILTER (WHERE next = '{s}'), 0) AS {s}" for s in decoding.STATES) + " FROM tr GROUP BY 1"),
    "viterbi_short": _viterbi_sql(False),
    "viterbi_with_end": _viterbi_sql(True),
    "argmax_labels": sql(WORDS, f", e AS (SELECT conv_id, utt, idx, j, (length(word) * 7 + idx * 3 + j * 5) % 11 AS e FROM words, (SELECT unnest(range({len(decoding.STATES)})) AS j)) SELECT conv_id, utt, idx, CAST(min({{'e': e, 'j': j}}).j AS INTEGER) AS label_idx FROM e GROUP BY 1, 2, 3"),
    "token_wer": sql(WORDS, _REF + " SELECT conv_id, utt, CAST(levenshtein(ref, hyp) AS INTEGER) AS distance, round(100.0 * levenshtein(ref, hyp) / length(ref), 6) AS wer FROM r"),
}
ORACLES["excision_features"] = sql(
    _MODEL.replace("{keys}", "r.conv_id, r.utt, r.idx, r.k")
    .replace("{rows}", "ex")
    .replace(
        "\nq AS (",
        """
ex AS (SELECT w.conv_id, w.utt, w.idx, k, coalesce(x.word, '<s>') AS a, coalesce(y.word, '<s>') AS b, w.word AS c FROM words w JOIN (SELECT unnest(range(9)) AS k) ON k <= w.idx
  LEFT JOIN words x ON x.conv_id = w.conv_id AND x.utt = w.utt AND x.idx = w.idx - k - 2 LEFT JOIN words y ON y.conv_id = w.conv_id AND y.utt = w.utt AND y.idx = w.idx - k - 1),
q AS (""",
    ),
    ", lp AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE log2(p) END AS lp FROM prob) SELECT conv_id, utt, idx, round(max(lp) FILTER (WHERE k > 0) - max(lp) FILTER (WHERE k = 0), 6) AS boost FROM lp GROUP BY 1, 2, 3",
)
def _source_sql(table: str, inc: str, before: str, columns: str) -> str:
    """Source scores over the words of ``table`` (their tags in ``inc``), which ``before`` may define."""
    body = _MODEL[len(WORDS) :].replace("FROM words ", f"FROM {table} ").replace("words.word", f"{table}.word")
    return sql(
        (TAGGED + _INC + before + body)
        .replace("{keys}", "r.conv_id, r.utt, r.last")
        .replace("{rows}", "gr")
        .replace(
            "\nq AS (",
            f"""
ft AS (SELECT conv_id, utt, idx, coalesce(n1.c, '<unk>') AS word, inc, contains(inc, '<e') OR contains(inc, '<i') AS ed, CAST(nullif(regexp_extract(inc, '<rm-([0-9]+)/>', 1), '') AS INTEGER) AS reach FROM {inc} LEFT JOIN n1 ON n1.c = {inc}.word),
fu AS (SELECT *, CASE WHEN ed OR EXISTS (SELECT 1 FROM ft o WHERE o.conv_id = ft.conv_id AND o.utt = ft.utt AND o.idx > ft.idx AND NOT o.ed AND o.idx - o.reach <= ft.idx) THEN '<e/>' WHEN reach IS NULL AND contains(inc, '<t') THEN '<s/>' ELSE '<f/>' END AS tag FROM ft),
sg AS (SELECT *, tag = '<s/>' AND idx > 0 AS beg, sum(CASE WHEN tag = '<s/>' AND idx > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, utt ORDER BY idx) AS seg, idx = max(idx) OVER (PARTITION BY conv_id, utt) AS last FROM fu),
sp AS (SELECT conv_id, utt, seg, idx, 1 AS kind, word AS c, last FROM sg WHERE tag <> '<e/>' UNION ALL SELECT conv_id, utt, seg - 1, idx, 0, '</s>', last FROM sg WHERE beg),
gr AS (SELECT *, coalesce(lag(c, 2) OVER w, '<s>') AS a, coalesce(lag(c, 1) OVER w, '<s>') AS b FROM sp WINDOW w AS (PARTITION BY conv_id, utt, seg ORDER BY idx, kind)),
q AS (""",
        ),
        f""", lp AS (SELECT conv_id, utt, last, CASE WHEN p > 0 THEN log2(p) ELSE CAST('-Infinity' AS DOUBLE) END AS lp FROM prob UNION ALL SELECT conv_id, utt, last, log2(0.01) FROM sg WHERE tag = '<e/>'),
lu AS (SELECT conv_id, utt, count(*) AS n FROM sg GROUP BY 1, 2), su AS (SELECT conv_id, utt, sum(lp) AS s, CASE WHEN sum(lp) FILTER (WHERE last) = 0 THEN log2(0.01) ELSE sum(lp) FILTER (WHERE last) END AS g FROM lp GROUP BY 1, 2)
SELECT conv_id, utt, {columns} FROM su JOIN lu USING (conv_id, utt)""",
    )


ORACLES["source_scores"] = _source_sql("words", "inc", "", "round(s, 6) AS source_score, round(g, 6) AS last_gain")
ORACLES["source_scores_of_pos"] = _source_sql(
    "pw", "pinc", ", pw AS (SELECT conv_id, utt, idx, 'P' || (length(word) % 5) AS word FROM words), pinc AS (SELECT * REPLACE ('P' || (length(word) % 5) AS word) FROM inc)", "round(s, 6) AS source_score, round(s / n, 6) AS per_word"
)
ORACLES = {k: v.replace("\n, ", ",\n", 1) if v.startswith("WITH") else v for k, v in ORACLES.items()}
