"""Words and tags that the queries work on, derived from the conversations by rules that Spark and SQL share.

words: one row per word of every turn, with a time line of 80 ms per character within each conversation and speaker.
tagged: reference and hypothesis tags. A word that repeats the one before it, or the one before that, is a repair onset; a few short words
are edit terms; the hypothesis differs from the reference at places picked by arithmetic on the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palaver.functions import tags as tag_functions
from palaver.sources.shared import folder, materialised  # noqa: F401

EDIT_WORDS = ("of", "de", "in", "der")
CHAR_MS = 80

WORD_KEY = ["conv_id", "speaker", "utt", "idx"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, speaker, utt, idx, n (words in the utterance), pos (place within conversation and speaker), word, start_ms, end_ms.

    Places within an utterance come from its array of words. Places within a conversation are running sums over one light row a turn, joined back by turn; so texts are
    shuffled at most once, by conversation and turn, and a long conversation is spread over tasks. Rows that repeat a turn each give their words, all from the place where
    that turn begins, and the next turn begins behind all of them; rows without conversation or turn number give none.
    """
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    # characters that do not count are taken out of the whole text, not word by word; texts are cut into words behind the shuffle
    spoken = turns.select("conv_id", F.col("role").alias("speaker"), F.col("turn").alias("utt"), F.regexp_replace(F.lower("text"), "[.,\"?()/']", "").alias("text"))
    said = F.array_remove(F.split("text", r"\s+"), "").alias("said")
    before = Window.partitionBy("conv_id", "speaker").orderBy("utt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spoken.select("conv_id", "speaker", "utt", said).select("conv_id", "speaker", "utt", F.size("said").alias("n"), F.length(F.concat_ws("", "said")).alias("letters")).repartition("conv_id", "speaker")
    sizes = sizes.groupBy("conv_id", "speaker", "utt").agg(F.sum("n").alias("n"), F.sum("letters").alias("letters")).filter("n > 0")
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = sizes.select("conv_id", F.col("speaker").alias("__speaker"), "utt", so_far("n").alias("words_before"), so_far("letters").alias("letters_before"))
    upto = F.aggregate("said", F.array(F.lit(0)), lambda done, w: F.concat(done, F.array(F.element_at(done, -1) + F.length(w))))
    turn = (spoken["conv_id"] == offsets["conv_id"]) & (spoken["utt"] == offsets["utt"]) & spoken["speaker"].eqNullSafe(offsets["__speaker"])
    found = spoken.join(offsets, turn).select(spoken["*"], "words_before", "letters_before")
    placed = found.select("conv_id", "speaker", "utt", "words_before", "letters_before", said).select("*", F.size("said").alias("n"), upto.alias("upto"))
    # a word is exploded with the letters up to it; the arrays themselves are not copied to its row
    each = placed.select("conv_id", "speaker", "utt", "n", "words_before", "letters_before", F.posexplode(F.arrays_zip("said", "upto", F.slice("upto", 2, F.col("n")).alias("through"))).alias("idx", "w")).filter("w.said is not null")
    at = lambda c: ((F.col("letters_before") + F.col(c)) * CHAR_MS).cast("long")
    return each.select("conv_id", "speaker", "utt", "idx", "n", (F.col("words_before") + F.col("idx")).cast("long").alias("pos"), F.col("w.said").alias("word"), at("w.upto").alias("start_ms"), at("w.through").alias("end_ms"))


WORDS = """
w0 AS (SELECT conv_id, role AS speaker, turn AS utt, list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda w: regexp_replace(w, '[.,"?()/'']', '', 'g')), lambda w: w <> '') AS l FROM conversations),
w1 AS (SELECT conv_id, speaker, utt, CAST(sum(len(l)) AS BIGINT) AS n, CAST(sum(length(array_to_string(l, ''))) AS BIGINT) AS letters FROM w0 WHERE len(l) > 0 GROUP BY 1, 2, 3),
w2 AS (SELECT conv_id, speaker, utt, CAST(sum(n) OVER line - n AS BIGINT) AS n, CAST(sum(letters) OVER line - letters AS BIGINT) AS letters FROM w1 WINDOW line AS (PARTITION BY conv_id, speaker ORDER BY utt)),
words AS (
  SELECT w.conv_id, w.speaker, w.utt, w.idx, w.len AS n, w2.n + w.idx AS pos, w.l[w.idx + 1] AS word,
    CAST(80 * (w2.letters + length(array_to_string(w.l[1:w.idx], ''))) AS BIGINT) AS start_ms, CAST(80 * (w2.letters + length(array_to_string(w.l[1:w.idx + 1], ''))) AS BIGINT) AS end_ms
  FROM (SELECT *, CAST(len(l) AS INTEGER) AS len, CAST(unnest(range(len(l))) AS INTEGER) AS idx FROM w0) w JOIN w2 ON w.conv_id = w2.conv_id AND w.utt = w2.utt AND w.speaker IS NOT DISTINCT FROM w2.speaker)"""


def by_line(df: DataFrame) -> DataFrame:
    """``df`` with a number for each speaker of a conversation in place of the conversation's, for results that have one key a line."""
    return df.withColumn("conv_id", F.col("conv_id") * 3 + F.when(F.col("speaker") == "user", 0).when(F.col("speaker") == "assistant", 1).otherwise(2))


LINES = "SELECT * REPLACE (conv_id * 3 + CASE speaker WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS conv_id) FROM"


def _atom(name: str, at: Column) -> Column:
    return F.concat(F.lit(f'<{name} id="'), at.cast("string"), F.lit('"/>'))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """words with gold and hyp (tag strings with segmentation atoms), repair_len (reparandum words, 0 if the word is no onset) and repair_type."""
    utterance = Window.partitionBy("conv_id", "utt").orderBy("idx")
    lag1, lag2 = F.lag("word", 1).over(utterance), F.lag("word", 2).over(utterance)
    onset = F.when(F.col("word") == lag1, 1).when(F.col("word") == lag2, 2).otherwise(0)
    kind = F.when(F.col("repair_len") == 1, "rep").when((F.col("repair_len") == 2) & (F.col("idx") % 2 == 0), "sub").when(F.col("repair_len") == 2, "del")
    marked = words(spark, sf_dir).withColumn("repair_len", onset).withColumn("repair_type", kind)
    next1, next2 = (F.coalesce(F.lead("repair_len", k).over(utterance), F.lit(0)) for k in (1, 2))
    none = F.lit("")
    repair = F.concat(
        F.when(next1 == 1, _atom("rms", F.col("pos") + 1)).otherwise(none),
        F.when(next2 == 2, _atom("rms", F.col("pos") + 2)).otherwise(none),
        F.when(next1 == 2, _atom("rm", F.col("pos") + 1)).otherwise(none),
        F.when(F.col("repair_len") > 0, F.concat(_atom("rps", F.col("pos")), F.concat(F.lit("<rpn"), F.col("repair_type"), F.lit(' id="'), F.col("pos").cast("string"), F.lit('"/>')))).otherwise(none),
    )
    plain = F.when(F.col("word").isin(*EDIT_WORDS), "<e/>").otherwise("<f/>")
    key = F.col("conv_id") * 31 + F.col("utt") * 7 + F.col("idx")
    place = tag_functions.continuation(F.col("idx") == 0, F.col("idx") == F.col("n") - 1)
    out = marked.withColumn("disf", F.when(repair != "", repair).otherwise(plain)).withColumn("key", key)
    hyp = F.when(F.col("key") % 11 == 0, "<f/>").when(F.col("key") % 13 == 0, "<e/>").otherwise(F.col("disf"))
    return out.withColumn("gold", F.concat("disf", place)).withColumn("hyp", F.concat(hyp, F.when(F.col("key") % 17 == 0, "<ct/>").otherwise(place))).drop("disf", "key")


TAGGED = (
    WORDS
    + """,
t0 AS (SELECT *, lag(word, 1) OVER u AS l1, lag(word, 2) OVER u AS l2 FROM words WINDOW u AS (PARTITION BY conv_id, utt ORDER BY idx)),
t1 AS (SELECT *, CASE WHEN word = l1 THEN 1 WHEN word = l2 THEN 2 ELSE 0 END AS repair_len FROM t0),
t2 AS (SELECT *, CASE WHEN repair_len = 1 THEN 'rep' WHEN repair_len = 2 AND idx % 2 = 0 THEN 'sub' WHEN repair_len = 2 THEN 'del' END AS repair_type,
    coalesce(lead(repair_len, 1) OVER u, 0) AS n1, coalesce(lead(repair_len, 2) OVER u, 0) AS n2, conv_id * 31 + utt * 7 + idx AS k,
    CASE WHEN idx = 0 THEN '<t' ELSE '<c' END || CASE WHEN idx = n - 1 THEN 't/>' ELSE 'c/>' END AS place
  FROM t1 WINDOW u AS (PARTITION BY conv_id, utt ORDER BY idx)),
t3 AS (SELECT *, CASE WHEN n1 = 1 THEN '<rms id="' || (pos + 1) || '"/>' ELSE '' END || CASE WHEN n2 = 2 THEN '<rms id="' || (pos + 2) || '"/>' ELSE '' END
    || CASE WHEN n1 = 2 THEN '<rm id="' || (pos + 1) || '"/>' ELSE '' END
    || CASE WHEN repair_len > 0 THEN '<rps id="' || pos || '"/><rpn' || repair_type || ' id="' || pos || '"/>' ELSE '' END AS repair FROM t2),
t4 AS (SELECT *, CASE WHEN repair <> '' THEN repair WHEN word IN ('of', 'de', 'in', 'der') THEN '<e/>' ELSE '<f/>' END AS disf FROM t3),
tagged AS (SELECT conv_id, speaker, utt, idx, n, pos, word, start_ms, end_ms, repair_len, repair_type, disf || place AS gold,
    CASE WHEN k % 11 = 0 THEN '<f/>' WHEN k % 13 = 0 THEN '<e/>' ELSE disf END || CASE WHEN k % 17 = 0 THEN '<ct/>' ELSE place END AS hyp FROM t4)"""
)


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"
