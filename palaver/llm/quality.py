"""Operator 2: quality classification by importance resampling over hashed n-grams.

Two generative models say which features a text holds: one of the target text (documents labelled good and not toxic), one of the raw text (all documents). Features are hashed unigrams of words and hashed
bigrams of token shapes (case, digits, symbols, repetition). Both models count the documents that hold a feature, and a text is scored by the features it holds, each once however often it says it: occurrences in one text are no
independent draws. A document's log importance weight is the sum of log(target rate / raw rate) over its features, of either sign.

* A document's own text is taken out of the counts that it is scored with. It is part of the raw text and may be of the target; else rare features would tell labelled from unlabelled documents instead of good from bad ones.
* Both rates are smoothed by ``PRIOR`` documents that hold the feature as often as chance has it (at the target's share of all documents).
* A ratio counts by the evidence for it: it is shrunk by z^2 / (z^2 + ``DOUBT``), z being how many standard deviations the number of target documents with the feature lies from chance. So no feature is left out and none decides alone,
  on small tables as on large ones.

Sampling is Gumbel top-k: key = log weight + Gumbel(0, 1), drawn from id and text, and the k largest keys stay. ``k`` is how many documents to keep; by default as many as are target-like: the target's share of the labelled documents,
plus ``MARGIN`` standard errors of that share, so that chance in the labels rather keeps than drops.

The corpus side counts every document; the target side is about ``TARGET_SAMPLE`` documents at most, chosen by the hash of their ids.

Defined results: null and empty texts have no features and weight 1; very long texts are read whole; a doc_id labelled more than once is a target only if all its
labels are good; without target documents every weight is 1 and all rows stay; rows that agree in doc_id and text share their draw, and where
they tie with the last key ``resample`` keeps any of them up to k and ``keep_good`` all; null doc_ids are carried through. ``resample`` reads only id and text, ``keep_good`` returns
all columns, whatever their names; doc_id, quality and toxic are read of the labels.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, PIECE_BYTES, free_name, hash_sample, in_pieces, map_batches, materialise, read_table, run_hashes, texts, top_k, unit_interval, words_in

WORD_BITS, SHAPE_BITS = 20, 18
FEATURES, FEATURE_BITS = (1 << WORD_BITS) + (1 << SHAPE_BITS), WORD_BITS + 1
TARGET_SAMPLE = 200_000
PRIOR = 2.0
#: Squared standard deviations at which evidence counts half: three deviations.
DOUBT = 9.0
MARGIN = 2.0
SEED = 2

#: Letters that a shape keeps.
SHAPE_LETTERS = 6
_ALNUM = np.frombuffer(bytes(0 if c == 0x20 else c for c in ALNUM), np.uint8)
_CLASS = np.array([0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256)], np.uint8)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _token_codes(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, shape hash, number of the text) of every token. The word is the token's letters and digits in lower case, or the token if it has none; the shape is its first classes of bytes, runs
    of one class as one."""
    letters, sizes, text = words_in(texts_)
    if not sizes.size:
        return np.empty(0, np.int64), np.empty(0, np.uint64), text
    first = np.cumsum(sizes) - sizes
    token = np.repeat(np.arange(sizes.size), sizes)
    alnum = _ALNUM[letters]
    spoken = np.add.reduceat(alnum > 0, first, dtype=np.int64) > 0
    used = (alnum > 0) | ~spoken[token]
    words = run_hashes(np.where(alnum > 0, alnum, letters)[used], np.bincount(token[used], minlength=sizes.size))
    classes = _CLASS[letters]
    begins = np.r_[True, classes[1:] != classes[:-1]]
    begins[first] = True
    of = token[begins]
    runs = np.bincount(of, minlength=sizes.size)
    short = np.arange(of.size) - np.repeat(np.cumsum(runs) - runs, runs) < SHAPE_LETTERS
    shapes = run_hashes(classes[begins][short], np.minimum(runs, SHAPE_LETTERS))
    return (words & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64), shapes & np.uint64(0xFFFFFFFF), text


def features(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word feature, shape bigram feature, number of the text) for every token of the texts."""
    words, shapes, text = in_pieces(texts_, _token_codes)
    if not words.size:
        return words, words, text
    follows = np.r_[False, text[1:] == text[:-1]]
    shapes = shapes * np.uint64(2) + (np.r_[False, words[1:] == words[:-1]] & follows)
    before = np.where(follows, np.r_[np.uint64(0), shapes[:-1]], np.uint64(0))
    return words, ((shapes * _A + before * _B) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS), text


def _parts(column: pa.Array):
    """(number of the first text, texts) of a column, about PIECE_BYTES at a time."""
    held, size, first = [], 0, 0
    for text in texts(column):
        held.append(text)
        size += len(text)
        if size >= PIECE_BYTES:
            yield first, held
            held, size, first = [], 0, first + len(held)
    if held:
        yield first, held


def target_ids(labels: DataFrame, sample: int = TARGET_SAMPLE) -> tuple[np.ndarray, float, int]:
    """Sorted ids of about ``sample`` documents (all if there are fewer) whose labels are all good and not toxic, the part of all labelled documents that are so, and how many are labelled."""
    judged = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_and(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good"))
    total, good = judged.agg(F.count(F.lit(1)), F.count(F.when(F.col("good"), 1))).first()
    ids = hash_sample(judged.filter("good").select("doc_id"), ["doc_id"], sample, good).collect()
    return np.sort(np.array([r[0] for r in ids], np.int64)), good / total if total else 0.0, total


def held_features(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, number of the text): every feature of every text once, in order."""
    words, shapes, text = features(texts_)
    once = np.unique(np.concatenate([text, text]) << FEATURE_BITS | np.concatenate([words, shapes]))
    return once & ((1 << FEATURE_BITS) - 1), once >> FEATURE_BITS


#: What is counted of every feature: documents in the raw and in the target text.
COUNTS = ("raw", "target")


def count_features(docs: DataFrame, target: np.ndarray) -> DataFrame:
    """feature and COUNTS over all ``docs(doc_id, text)``; feature FEATURES holds all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(target)

    def count(batches):
        good = shared.value
        sums = np.zeros((len(COUNTS), FEATURES + 1), np.int64)
        for batch in batches:
            ids, known = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            target_rows = known & np.isin(ids, good)
            sums[:, FEATURES] += batch.num_rows, target_rows.sum()
            for first, part in _parts(batch.column(1)):
                found, text = held_features(part)
                np.add.at(sums[0], found, 1)
                np.add.at(sums[1], found[target_rows[first + text]], 1)
        at = np.flatnonzero(sums[0])
        for part in np.array_split(at, max(1, at.size // 50_000)):
            yield pa.RecordBatch.from_pydict({"feature": pa.array(part)} | {c: pa.array(s[part]) for c, s in zip(COUNTS, sums)})

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "feature long, " + ", ".join(f"{c} long" for c in COUNTS))
    return counts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in COUNTS))


def ratios(raw: np.ndarray, target: np.ndarray, chance: float, prior: float = PRIOR, doubt: float = DOUBT) -> np.ndarray:
    """Shrunk log ratios of target to raw rates for numbers of documents that hold a feature; 0 where none does."""
    expected = chance * raw
    squared = (target - expected) ** 2
    evidence = np.divide(squared, squared + doubt * expected * (1 - chance), out=np.zeros(len(raw)), where=squared > 0)
    return np.log((target + prior * chance) / (expected + prior * chance)) * evidence


def fit(docs: DataFrame, labels: DataFrame, sample: int = TARGET_SAMPLE) -> dict | None:
    """``target`` (ids), ``part`` (of the labelled documents that are target-like), ``labelled``, and the log ratios of all features as documents of the raw text (``outside``) and of the target (``inside``) are scored with them;
    None without target documents."""
    target, part, labelled = target_ids(labels, sample)
    found = count_features(docs, target).toArrow()
    feature, (raw, held) = found["feature"].to_numpy(), (found[c].to_numpy() for c in COUNTS)
    size = feature == FEATURES
    if not size.any() or not held[size][0]:
        return None
    chance = float(held[size][0] / raw[size][0])
    known = ~size
    out = {"target": target, "part": part, "labelled": labelled}
    for name, own in (("outside", 0), ("inside", 1)):
        out[name] = np.zeros(FEATURES)
        out[name][feature[known]] = ratios(np.maximum(raw[known] - 1, 0), np.maximum(held[known] - own, 0), chance)
    return out


def score(docs: DataFrame, model: dict | None, columns: list[str], weight: str) -> DataFrame:
    """The named columns of ``docs`` and the log weight of its texts under the name ``weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = free_name("text", columns)
    doc_id = free_name("doc_id", [*columns, text])
    rows = docs.select(*columns, F.col("text").cast("string").alias(text), F.col("doc_id").cast("long").alias(doc_id))

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            weights = np.zeros(batch.num_rows)
            if model is not None:
                ids = batch.column(len(columns) + 1)
                inside = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), model["target"]) & ids.is_valid().to_numpy(zero_copy_only=False)
                for first, part in _parts(batch.column(len(columns))):
                    # a text's terms are added in the order of its features, so it weighs the same wherever it stands
                    found, number = held_features(part)
                    ratio = np.where(inside[first + number], model["inside"][found], model["outside"][found])
                    weights[first : first + len(part)] = np.bincount(number, ratio, len(part))
            return pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(weights, pa.float64())], names=[*columns, weight])

        return step

    return map_batches(rows, make, T.StructType([*rows.schema.fields[:-2], T.StructField(weight, T.DoubleType())]))


def gumbel_key(weight: str, draw):
    return F.col(weight) - F.log(-F.log(draw))


def _draw(seed: int = SEED):
    return unit_interval(F.lit(seed), F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))


def to_keep(rows: int, part: float, labelled: int, margin: float = MARGIN) -> int:
    """How many of ``rows`` documents are target-like if ``part`` of the labelled ones are, plus ``margin`` standard errors."""
    return min(rows, round(rows * (part + margin * math.sqrt(part * (1 - part) / labelled))))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, **how) -> tuple[DataFrame, dict | None]:
    """(doc_id, log_weight, key of the documents that stay; the model)."""
    model = fit(docs, labels, **how)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), _draw().alias("draw"))
    thin = score(rows, model, ["doc_id", "draw"], "log_weight")
    thin = materialise(thin.select("doc_id", "log_weight", gumbel_key("log_weight", F.col("draw")).alias("key")))
    if k is None:
        k = thin.count()
        k = k if model is None else to_keep(k, model["part"], model["labelled"])
    return top_k(thin, "key", k, ["doc_id"]), model


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that resampling keeps or that are no less likely in the target than in the raw text, with all their columns: only what speaks against a text drops it. The cut-off key is found on the scores alone; the texts are scored
    again rather than shuffled. Rows that tie with the cut-off stay."""
    kept, model = resample(docs, labels)
    lowest = kept.agg(F.min("key")).first()[0]
    if lowest is None:
        return docs.limit(0)
    draw = free_name("draw", docs.columns)
    weight = free_name("weight", [*docs.columns, draw])
    scored = score(docs.withColumn(draw, _draw()), model, [*docs.columns, draw], weight)
    return scored.filter((gumbel_key(weight, F.col(draw)) >= F.lit(lowest)) | (F.col(weight) >= 0)).select(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return resample(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))[0]
