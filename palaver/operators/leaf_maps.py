"""Maps from transcript words to the leaves of parse trees.

Trees do not keep to turns, split words (``do`` + ``n't``), hold traces and punctuation that nobody said, and lack leaves of words that were. Words and leaves are read as two streams of letters, in which splits and borders do
not show; what differs is letters that one side lacks. The streams of a speaker are aligned piece by piece: a stretch of letters that stands once in either stream is an anchor, if all anchors before and behind it agree on
the order; between two anchors a piece is aligned word by word, at a cost of its
words times its leaves. Pieces are some dozens of words, longer where a speaker says the same passages over and over.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRACE = "-NONE-"
#: Letters of an anchor; one place in SPARSE is tried, chosen by its letters.
ANCHOR, SPARSE = 24, 4


def letters(token: Column) -> Column:
    """What words and leaves are compared by: letters and digits in lower case."""
    return F.replace(F.regexp_replace(F.lower(token), r"[^\p{L}\p{N}]", ""), F.lit("ß"), F.lit("ss"))  # as capitals have it


def _with_keys(units: DataFrame, by: list[str], group: str, at: str) -> DataFrame:
    """``units(by, group, at, c)`` with ``place`` (their order in the stream) and ``key``: the letters around the place, half of them before it, where it may be an anchor. Letters run over the ends of turns and trees: cut there, a passage that is said
    twice would meet the other one's leaves where a turn ends behind the one and a tree behind the other. At the first of the letters it would part words from their leaves where the word behind them, made of the same letters, lacks its own."""
    line, half = Window.partitionBy(*by).orderBy(group, at), ANCHOR // 2
    around = lambda first, last: F.concat_ws("", F.collect_list("c").over(line.rowsBetween(first, last)))
    key = F.concat(F.right(around(-half, -1), F.lit(half)), F.left(around(0, half - 1), F.lit(half)))
    chosen = (F.length(key) == ANCHOR) & (F.pmod(F.xxhash64(key), F.lit(SPARSE)) == 0)
    return units.select(*by, group, at, "c", F.struct(F.col(group).cast("long").alias("g"), F.col(at).cast("long").alias("i")).alias("place"), F.when(chosen, key).alias("key"))


def _anchors(words: DataFrame, leaves: DataFrame, by: list[str]) -> DataFrame:
    """(by, w, l): places of words and leaves from which the same unique letters run, in one order on both sides."""
    once = lambda df, name: df.filter("key is not null").groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias(name)).filter("n = 1").drop("n")
    found = once(words, "w").join(once(leaves, "l"), [*by, "key"]).drop("key")
    before = Window.partitionBy(*by).orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*by).orderBy(F.col("w").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least, most = F.max("l").over(before), F.min("l").over(behind)
    agreed = found.select(*by, "w", "l", (least.isNull() | (least < F.col("l"))).alias("up"), (most.isNull() | (most > F.col("l"))).alias("down"))
    return agreed.filter("up and down").select(*by, "w", "l")


def _pieces(units: DataFrame, anchors: DataFrame, by: list[str], side: str, values: list[str]) -> DataFrame:
    """(by, piece, side): the units of each piece in order. A piece is named by the word place of the anchor that it begins with; null before the first."""
    marks = anchors.select(*by, F.col(side).alias("place"), F.col("w").alias("__piece"))
    # a unit at an anchor's place belongs to the piece that begins there
    line = Window.partitionBy(*by).orderBy("place")
    both = units.join(marks, [*by, "place"], "left").withColumn("piece", F.last("__piece", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return both.groupBy(*by, "piece").agg(F.array_sort(F.collect_list(F.struct("place", *values))).alias(side))


#: How many words and leaves may stand for each other.
TOGETHER = ((1, 1), (1, 2), (1, 3), (2, 1), (3, 1))


def align(words: list[str], leaves: list[str]) -> list[list[int]]:
    """Leaves of each word, both given by their letters. Equal words and leaves at both ends stand for each other; what is between them gets the alignment in order that matches most letters, in which a word equals a leaf or up to
    three leaves end to end, or a leaf equals up to three words. Of equally good ones it matches the most words, so a word that lacks its leaf does not take those of the words that it is made of; then the earlier ones."""
    found: list[list[int]] = [[] for _ in words]
    first, last = 0, 0
    short = min(len(words), len(leaves))
    while first < short and words[first] == leaves[first]:
        found[first] = [first]
        first += 1
    while last < short - first and words[-1 - last] == leaves[-1 - last]:
        last += 1
        found[-last] = [len(leaves) - last]
    said, held = words[first : len(words) - last], leaves[first : len(leaves) - last]
    n, m = len(said), len(held)
    # best[i][j]: letters that can be matched from word i and leaf j on, and behind them the words, which weigh less than a letter; move[i][j]: the move that begins there
    letter = n + 1
    best, move = [[0] * (m + 1) for _ in range(n + 1)], [bytearray(m) for _ in range(n)]
    for i in reversed(range(n)):
        word, row, below, moves = said[i], best[i], best[i + 1], move[i]
        for j in reversed(range(m)):
            score, which = (row[j + 1], 6) if row[j + 1] > below[j] else (below[j], 7)
            if word[0] == held[j][0]:
                for k, (p, q) in enumerate(TOGETHER):
                    if i + p <= n and j + q <= m and "".join(said[i : i + p]) == "".join(held[j : j + q]):
                        total = len("".join(said[i : i + p])) * letter + p + best[i + p][j + q]
                        if total >= score:
                            score, which = total, k
            row[j], moves[j] = score, which
    i = j = 0
    while i < n and j < m:
        which = move[i][j]
        if which < 6:
            p, q = TOGETHER[which]
            for k in range(i, i + p):
                found[first + k] = list(range(first + j, first + j + q))
            i, j = i + p, j + q
        else:
            i, j = (i, j + 1) if which == 6 else (i + 1, j)
    return found


def leaf_map(words: DataFrame, leaves: DataFrame, by: list[str]) -> DataFrame:
    """by, utt, idx and nodes (array of tree, leaf) of each word of ``words(by, utt, idx, word)``, from ``leaves(by, tree, leaf, token, pos)`` in the order of trees and leaves.

    A word has no nodes if it has no letters, its leaf is missing or the speaker has no trees; traces and leaves without letters are no word's. Utterance, word, tree and leaf numbers are integers; words and leaves without
    them, or null tokens, are left out.
    """
    w = words.select(*by, "utt", "idx", letters(F.col("word")).alias("c")).filter("utt is not null and idx is not null")
    spoken = _with_keys(w.filter("c <> ''"), by, "utt", "idx")
    heard = leaves.filter(F.coalesce(F.col("pos") != TRACE, F.lit(True))).select(*by, "tree", "leaf", letters(F.col("token")).alias("c")).filter("c <> '' and tree is not null and leaf is not null")
    heard = _with_keys(heard, by, "tree", "leaf")
    anchors = _anchors(spoken, heard, by)
    mine, theirs = _pieces(spoken, anchors, by, "w", ["c"]), _pieces(heard, anchors, by, "l", ["c"])
    same = [mine[c].eqNullSafe(theirs[c]) for c in [*by, "piece"]]
    joined = mine.join(theirs, same, "left").select(*(mine[c] for c in by), "w", "l")
    kind = pa.list_(pa.list_(pa.struct([("tree", pa.int64()), ("leaf", pa.int64())])))

    def run(batches):
        for batch in batches:
            found = []
            for said, held in zip(batch.column(len(by)).to_pylist(), batch.column(len(by) + 1).to_pylist(), strict=True):
                held = held or []
                nodes = [{"tree": x["place"]["g"], "leaf": x["place"]["i"]} for x in held]
                found.append([[nodes[k] for k in ks] for ks in align([x["c"] for x in said], [x["c"] for x in held])])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by) + 1], pa.array(found, kind)], names=[*batch.schema.names[: len(by) + 1], "nodes"])

    schema = ", ".join(f"`{c}` {t}" for c, t in joined.drop("l").dtypes) + ", nodes array<array<struct<tree:bigint,leaf:bigint>>>"
    mapped = joined.mapInArrow(run, schema).select(*by, F.explode(F.arrays_zip("w", "nodes")).alias("z")).select(*by, F.col("z.w.place.g").alias("utt"), F.col("z.w.place.i").alias("idx"), "z.nodes")
    types = dict(words.dtypes)
    mapped = mapped.select(*by, *(F.col(c).cast(types[c]).alias(c) for c in ("utt", "idx")), "nodes")
    silent = w.filter("c = '' or c is null").select(*by, "utt", "idx", F.array().cast("array<struct<tree:bigint,leaf:bigint>>").alias("nodes"))
    return mapped.unionByName(silent)
