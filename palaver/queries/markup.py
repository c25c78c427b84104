"""Queries over annotation by hand: repairs in bracket markup, and maps of words to the leaves of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palaver.operators import leaf_maps, markup
from palaver.sources import readers, writers

from .base import EDIT_WORDS, WORDS, folder, materialised, words

LINE = ["conv_id", "speaker"]


def marked_turns(w: DataFrame) -> DataFrame:
    """Turns of words with marks by arithmetic on the words' keys: nested, across turns, without a point, never closed and closed without being opened."""
    key = F.pmod(F.col("conv_id") * 31 + F.col("utt") * 7 + F.col("idx"), F.lit(23))
    before = F.when(key.isin(0, 7, 21), "[ ").when(key == 12, "[ [ ").when(key.isin(3, 9, 14), "+ ").when(key == 15, "] + ").otherwise("")
    behind = F.when(key.isin(5, 10), " ]").when(key == 18, " ] ]").otherwise("")
    word = F.when(F.col("word").isin(*EDIT_WORDS), F.concat(F.lit("{F "), F.col("word"), F.lit(" }"))).when(key == 20, F.concat(F.lit("{C "), F.col("word"), F.lit(" }"))).otherwise(F.col("word"))
    # words that look like marks are no words here
    spoken = w.filter("not (word in ('[', '+', ']', '}') or startswith(word, '{'))").withColumn("t", F.concat(before, word, behind))
    return spoken.groupBy(*LINE, "utt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda s: s["t"]), " ").alias("text"))


def markup_repairs(spark: SparkSession, sf: str) -> DataFrame:
    return markup.markup_repairs(marked_turns(words(spark, sf)), LINE, keep=lambda df: materialised(df, "marks"))


def damaged_leaves(w: DataFrame) -> DataFrame:
    """Leaves of trees over nine words each, which do not keep to turns: by the words' keys some are split in two, in capitals, missing, or have a trace before or a comma behind them."""
    line = Window.partitionBy(*LINE).orderBy("pos")
    key = F.pmod(F.col("conv_id") * 31 + F.col("pos"), F.lit(29))
    alone = (F.coalesce(F.lag("word").over(line), F.lit("")) != F.col("word")) & (F.coalesce(F.lead("word").over(line), F.lit("")) != F.col("word"))
    leaf = lambda token, pos: F.struct(token.alias("token"), F.lit(pos).alias("pos"))
    word, n = F.col("word"), F.length("word")
    split = F.array(leaf(F.substring(word, F.lit(1), n - 3), "VB"), leaf(F.substring(word, n - 2, F.lit(3)), "RB"))
    told = F.when(key.isin(3, 22) & alone, F.array().cast("array<struct<token:string,pos:string>>")).when(key.isin(7, 18) & (n > 3), split).when(key == 20, F.array(leaf(F.upper(word), "NN"))).otherwise(F.array(leaf(word, "NN")))
    every = F.concat(F.when(key == 11, F.array(leaf(F.lit("*T*-1"), leaf_maps.TRACE))).otherwise(F.array().cast("array<struct<token:string,pos:string>>")), told, F.when(key == 15, F.array(leaf(F.lit(","), ","))).otherwise(F.array().cast("array<struct<token:string,pos:string>>")))
    flat = w.select(*LINE, "pos", F.floor(F.col("pos") / 9).cast("int").alias("tree"), every.alias("e")).select(*LINE, "pos", "tree", F.posexplode("e").alias("k", "x"))
    nth = F.row_number().over(Window.partitionBy(*LINE, "tree").orderBy("pos", "k")) - 1
    return flat.select(*LINE, "tree", nth.alias("leaf"), "x.token", "x.pos")


def tree_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Words mapped to the leaves of damaged trees; the maps are written as lines, read back and looked up."""
    w = materialised(words(spark, sf), "words")
    found = leaf_maps.leaf_map(w, materialised(damaged_leaves(w), "leaves"), LINE)
    listed = found.groupBy(*LINE, "utt").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "nodes"))), lambda s: s["nodes"]).alias("nodes"))
    at = folder(spark, "tree-maps")
    writers.write_text(writers.tree_map(listed.select(F.concat_ws(":", *LINE, "utt").alias("utt_ref"), "nodes")), at, ["utt_ref"])
    read = readers.with_node_map(w.groupBy(*LINE, "utt").agg(F.max("n").alias("n")).withColumn("utt_ref", F.concat_ws(":", *LINE, "utt")), readers.tree_map(spark, at), "n")
    each = read.select(*LINE, "utt", F.posexplode("nodes").alias("idx", "nodes"))
    return each.select(*LINE, "utt", "idx", F.concat_ws(",", F.transform("nodes", lambda x: F.concat_ws(":", x["tree"], x["leaf"]))).alias("nodes"))


QUERIES = {f.__name__: f for f in (markup_repairs, tree_maps)}

_MARKED = (
    WORDS
    + """,
mk AS (SELECT *, (conv_id * 31 + utt * 7 + idx) % 23 AS k FROM words WHERE NOT (word IN ('[', '+', ']', '}') OR starts_with(word, '{'))),
mt AS (SELECT conv_id, speaker, utt, string_agg(CASE WHEN k IN (0, 7, 21) THEN '[ ' WHEN k = 12 THEN '[ [ ' WHEN k IN (3, 9, 14) THEN '+ ' WHEN k = 15 THEN '] + ' ELSE '' END
    || CASE WHEN word IN ('of', 'de', 'in', 'der') THEN '{F ' || word || ' }' WHEN k = 20 THEN '{C ' || word || ' }' ELSE word END
    || CASE WHEN k IN (5, 10) THEN ' ]' WHEN k = 18 THEN ' ] ]' ELSE '' END, ' ' ORDER BY idx) AS text FROM mk GROUP BY 1, 2, 3),
tk AS (SELECT conv_id, speaker, utt, i, l[i + 1] AS token FROM (SELECT *, string_split(text, ' ') AS l, unnest(range(len(string_split(text, ' ')))) AS i FROM mt)),
ed AS (SELECT *, last_value(CASE WHEN starts_with(token, '{') AND NOT starts_with(token, '{C') THEN 1 WHEN token = '}' THEN 0 END IGNORE NULLS) OVER (PARTITION BY conv_id, speaker, utt ORDER BY i) AS b,
    NOT (token IN ('[', '+', ']', '}') OR starts_with(token, '{')) AS wd FROM tk),
nm AS (SELECT *, row_number() OVER o AS pl, wd AND coalesce(b, 0) = 0 AS plain, sum(CASE WHEN wd THEN 1 ELSE 0 END) OVER o - CASE WHEN wd THEN 1 ELSE 0 END AS w FROM ed WINDOW o AS (PARTITION BY conv_id, speaker ORDER BY utt, i)),"""
)

#: A stack of open repairs is carried along each speaker's line, token by token.
ORACLES = {
    "markup_repairs": f"""WITH RECURSIVE {_MARKED.strip()}
run AS (
  SELECT conv_id, speaker, CAST(0 AS BIGINT) AS pl, CAST([] AS STRUCT(utt BIGINT, mark BIGINT, inside VARCHAR, f HUGEINT, p HUGEINT, pa BIGINT)[]) AS stack, CAST(NULL AS STRUCT(utt BIGINT, mark BIGINT, inside VARCHAR, f HUGEINT, p HUGEINT, pa BIGINT)) AS done, 0 AS level,
    CAST(NULL AS HUGEINT) AS e, CAST(NULL AS BIGINT) AS end_utt FROM (SELECT DISTINCT conv_id, speaker FROM nm)
  UNION ALL
  SELECT n.conv_id, n.speaker, n.pl,
    CASE n.token WHEN '[' THEN list_append(r.stack, {{'utt': n.utt, 'mark': n.i, 'inside': CASE WHEN len(r.stack) = 0 THEN '' WHEN r.stack[-1].p IS NULL THEN 'reparandum' ELSE 'repair' END, 'f': n.w, 'p': NULL, 'pa': NULL}})
      WHEN '+' THEN CASE WHEN len(r.stack) = 0 OR r.stack[-1].p IS NOT NULL THEN r.stack ELSE list_append(r.stack[:-2], {{'utt': r.stack[-1].utt, 'mark': r.stack[-1].mark, 'inside': r.stack[-1].inside, 'f': r.stack[-1].f, 'p': n.w, 'pa': n.pl}}) END
      WHEN ']' THEN r.stack[:-2] ELSE r.stack END,
    CASE WHEN n.token = ']' AND len(r.stack) > 0 THEN r.stack[-1] END, CAST(len(r.stack) AS INTEGER), CASE WHEN n.token = ']' THEN n.w END, CASE WHEN n.token = ']' THEN n.utt END
  FROM run r JOIN nm n ON n.conv_id = r.conv_id AND n.speaker = r.speaker AND n.pl = r.pl + 1),
closed AS (SELECT conv_id, speaker, done.utt, done.mark, level, done.inside, done.f, done.p, done.pa, e, end_utt FROM run WHERE done IS NOT NULL),
left_open AS (SELECT conv_id, speaker, unnest(stack) AS d, unnest(range(1, len(stack) + 1)) AS level FROM (SELECT conv_id, speaker, max_by(stack, pl) AS stack FROM run GROUP BY 1, 2)),
every AS (SELECT * FROM closed UNION ALL SELECT conv_id, speaker, d.utt, d.mark, CAST(level AS INTEGER), d.inside, d.f, d.p, d.pa, NULL, NULL FROM left_open)
SELECT conv_id, speaker, utt, CAST(mark AS INTEGER) AS mark, level, inside, CAST(f AS BIGINT) AS first, CAST(p AS BIGINT) AS point,
  CAST(CASE WHEN p IS NOT NULL AND e IS NOT NULL THEN least(e, coalesce((SELECT min(w) FROM nm WHERE nm.conv_id = v.conv_id AND nm.speaker = v.speaker AND nm.plain AND nm.pl > v.pa), e)) END AS BIGINT) AS repair, CAST(e AS BIGINT) AS "end", end_utt
FROM every v""",
    # what the trees were before they were damaged
    "tree_maps": f"""WITH {WORDS.strip()},
dm AS (SELECT *, (conv_id * 31 + pos) % 29 AS k, coalesce(lag(word) OVER l, '') <> word AND coalesce(lead(word) OVER l, '') <> word AS alone, pos // 9 AS tree FROM words WINDOW l AS (PARTITION BY conv_id, speaker ORDER BY pos)),
pt AS (SELECT *, CASE WHEN k = 11 THEN 1 ELSE 0 END AS b, CASE WHEN k IN (3, 22) AND alone THEN 0 WHEN k IN (7, 18) AND length(word) > 3 THEN 2 ELSE 1 END AS m, CASE WHEN k = 15 THEN 1 ELSE 0 END AS a FROM dm),
st AS (SELECT *, sum(b + m + a) OVER (PARTITION BY conv_id, speaker, tree ORDER BY pos) - m - a AS s FROM pt)
SELECT conv_id, speaker, utt, idx, CASE WHEN m = 0 OR regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g') = '' THEN '' WHEN m = 1 THEN tree || ':' || CAST(s AS BIGINT) ELSE tree || ':' || CAST(s AS BIGINT) || ',' || tree || ':' || CAST(s + 1 AS BIGINT) END AS nodes FROM st""",
}
