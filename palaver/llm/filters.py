"""Operator 12: how text filters interact, in every order in which they may be applied.

Five filters look at a whole text (words: maximal runs of characters other than blanks, case matters): A too few words, B too few distinct words, C too many capital letters, D holds a
symbol of ``SYMBOLS``, E is identical to the text of a smaller doc_id anywhere in the table. A to D are bits of a mask that one pass over the texts gives.

E is found by refining a partition of the documents. Classes are first the texts of equal length in code points, then those whose first block has the same hash, then those whose next block has, with
blocks that grow eightfold so that the rounds grow with the logarithm of the longest text; a class of one drops out at once. Length and hashes were taken in the pass that gave the masks, so rounds
work on narrow rows. What survives is compared in full: texts of the surviving classes are grouped by class and text (equal texts of a task are one row before they are shuffled), and the smallest doc_id of each text goes back to
its class. Should one class hold several texts (a hash collision), its documents are matched by their texts instead. A document fails E if its doc_id is larger than the smallest one of its text.

Masks are then counted for each part, and all orders and steps are sums over a part's 32 counts.

Defined results: null texts are empty; very long texts are read whole; rows that repeat a doc_id count each, the smallest doc_id of a text may stand in several rows, and all of these pass E; rows
without doc_id are neither smaller nor larger than any, so they pass E; a null part is the empty string; labels of a doc_id that is labelled more than once count if any of them does, rows without labels count
as neither; an empty table gives no row. Of the documents only doc_id, text and the part are read, of the labels doc_id, quality and toxic, so further columns of any name do not matter.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, map_batches, materialise, read_table, texts

FILTERS = "ABCDE"
# fixed values: the failure conditions
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"

#: Bytes of the first block that is hashed; each later block is eight times as long.
BLOCK, GROWTH = 256, 8

_CAPITALS = bytes(range(0x41, 0x5B))
_FOLLOWING = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point

#: Columns of a document's class: equal texts have equal classes.
CLASS = ["n_points", "blocks"]


def text_mask(text: bytes) -> int:
    """Bits 0 to 3: whether the text fails A, B, C, D."""
    words = text.split()
    points = len(text.translate(None, _FOLLOWING))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (len(words) < FEWEST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1 | (100 * capitals > CAPITAL_PERCENT * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


def block_hashes(text: bytes, bits: int) -> list[int]:
    out, at, size = [], 0, BLOCK
    while at < len(text):
        out.append(xxhash.xxh3_64_intdigest(text[at : at + size]) >> (64 - bits) if bits else 0)
        at, size = at + size, size * GROWTH
    return out


def _described(docs: DataFrame, with_text: bool, bits: int) -> DataFrame:
    """doc_id, part, mask, n_points, blocks (and text) of each row of ``docs(doc_id, part, text)``."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            masks, points, blocks = [], [], []
            for text in texts(batch.column(2)):
                masks.append(text_mask(text))
                points.append(len(text.translate(None, _FOLLOWING)))
                blocks.append(np.array(block_hashes(text, bits), np.uint64).view(np.int64))
            out = {"doc_id": batch.column(0), "part": batch.column(1), "mask": pa.array(masks, pa.int32()), "n_points": pa.array(points, pa.int64()), "blocks": pa.array(blocks, pa.list_(pa.int64()))}
            return pa.RecordBatch.from_pydict(out | {"text": batch.column(2)} if with_text else out)

        return step

    return map_batches(docs, make, "doc_id long, part string, mask int, n_points long, blocks array<long>" + ", text string" * with_text)


def _surviving_classes(rows: DataFrame) -> DataFrame:
    """(n_points, blocks) of the classes with more than one row, found by refinement; written to the shared folder."""
    members = rows.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"))  # rows that agree in all blocks stay together in every round
    level = 0
    while True:
        refined = ["n_points", "prefix"]
        members = members.withColumn("prefix", F.slice("blocks", 1, level))
        classes = members.groupBy(*refined).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("members")).filter("rows > 1")
        members = materialise(join_counted(members.select(*CLASS, "n", "prefix"), materialise(classes), refined, "members").select(*CLASS, "n"))
        longest = members.agg(F.max(F.size("blocks"))).first()[0]
        if longest is None or level >= longest:
            return members.select(*CLASS)
        level += 1


def mark_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, part and mask (bit 4: E) of each row of ``docs(doc_id long, part string, text string)``. ``bits``: of the block hashes."""
    rows = materialise(_described(docs, False, bits))
    surviving = _surviving_classes(rows)
    described = _described(docs, True, bits)
    whole = described.join(surviving, CLASS, "left_semi").groupBy(*CLASS, "text").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    whole = materialise(whole)
    classes = materialise(whole.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("texts"), F.min("least").alias("least"), F.sum("n").alias("n")))
    larger = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    mask = (F.col("mask") + F.when(larger, 16).otherwise(0)).cast("int").alias("mask")
    found = join_counted(rows, classes, CLASS, "n", "left")
    marked = found.filter("texts is null or texts = 1").select("doc_id", "part", mask)
    collided = materialise(classes.filter("texts > 1").select(*CLASS))
    if collided.isEmpty():
        return marked
    told_apart = join_counted(described.join(collided, CLASS, "left_semi"), whole, [*CLASS, "text"], "n")
    return marked.unionByName(told_apart.select("doc_id", "part", mask))


_ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _sums() -> dict[str, np.ndarray]:
    """For each figure, which of the 32 masks count at each order and step: arrays of 32 x 600; shapley counts a mask once for each order in which its filter removes it."""
    masks = np.arange(32)
    out = {k: np.zeros((32, len(_ORDERS) * 5), np.int64) for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    credit = np.zeros((32, 5), np.int64)
    for i, order in enumerate(_ORDERS):
        before = 0
        for step, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails, gone, at = masks & bit > 0, masks & before > 0, i * 5 + step
            out["removed"][:, at] = fails & ~gone
            out["redundant"][:, at] = fails & gone
            out["unique_fails"][:, at] = masks == bit
            out["kept"][:, at] = ~fails & ~gone
            credit[:, FILTERS.index(letter)] += fails & ~gone
            before |= bit
    for i, order in enumerate(_ORDERS):
        for step, letter in enumerate(order):
            out["shapley"][:, i * 5 + step] = credit[:, FILTERS.index(letter)]
    return out


_FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of filters and step, from ``marked(doc_id, part, mask)`` and ``labels(doc_id, quality, toxic)``."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    # equal (id, part, mask) are one row from here on; a row without doc_id has no labels and needs no join
    counted = marked.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    labelled = counted.join(known, "doc_id", "left").select("part", "mask", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")))
    by_mask = labelled.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    counts = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(32))).cast("array<long>").alias(c)
    parts = by_mask.groupBy("part").agg(counts("n"), counts("good"), counts("toxic"))

    def make():
        sums = _sums()
        orders, steps = pa.array([o for o in _ORDERS for _ in range(5)]), pa.array([s for _ in _ORDERS for s in range(1, 6)], pa.int32())

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, good, toxic = (np.asarray(batch.column(k).flatten()).reshape(batch.num_rows, 32) for k in (1, 2, 3))
            values = {k: n @ s for k, s in sums.items()} | {"good_lost": good @ sums["removed"], "toxic_lost": toxic @ sums["removed"]}
            rows = batch.num_rows
            part = batch.column(0).take(pa.array(np.repeat(np.arange(rows), len(_ORDERS) * 5)))
            return pa.RecordBatch.from_pydict({"part": part, "filter_order": pa.concat_arrays([orders] * rows), "step": pa.concat_arrays([steps] * rows)} | {k: values[k].ravel() for k in _FIGURES})

        return step

    return map_batches(parts, make, "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in _FIGURES))


def audit_filters(docs: DataFrame, labels: DataFrame, part: Column, bits: int = 64) -> DataFrame:
    """The audit of ``docs(doc_id, text, ...)`` by the values of ``part``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return audit(mark_duplicates(rows, bits), labels)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"), read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), F.col("source"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT doc_id, part, CAST(len(l) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(l)) < 65 * len(l) AS INTEGER)
    + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS INTEGER) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(doc_id > least, false) AS INTEGER) AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS t FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(q, 0)) AS q, sum(coalesce(t, 0)) AS t FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f(letter, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
z AS (SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN q ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN t ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM z
"""
