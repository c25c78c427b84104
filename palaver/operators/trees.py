"""Column functions over parse trees given by addresses: a node's address is the path of child numbers from the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_ancestor(mother: Column, daughter: Column) -> Column:
    """Is the first address a strict prefix of the second?"""
    n = F.size(mother)
    return (n < F.size(daughter)) & ((n == 0) | (F.slice(daughter, 1, n) == mother))


def ancestors(address: Column) -> Column:
    """All proper prefixes, the root first."""
    n = F.size(address)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(address, 1, k))).otherwise(F.array().cast("array<array<int>>"))


def depth(address: Column, labels: Column | None = None, skipped: str = "EDITED") -> Column:
    """Depth of a node; ancestors labelled ``skipped`` do not count (``labels`` holds the ancestors' labels)."""
    if labels is None:
        return F.size(address)
    return F.size(address) - F.size(F.filter(labels, lambda x: x == skipped))


def path_length(a: Column, b: Column) -> Column:
    """Edges between two nodes."""
    n = F.least(F.size(a), F.size(b))
    shared = F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.slice(a, 1, k) == F.slice(b, 1, k)))).otherwise(0)
    return F.size(a) + F.size(b) - 2 * shared


def is_edited(labels: Column) -> Column:
    return F.exists(labels, lambda x: x == "EDITED")


def edited_positions(edited: Column) -> Column:
    """Positions of the true entries of a boolean array."""
    return F.filter(F.transform(edited, lambda e, i: F.when(e, i)), lambda i: i.isNotNull())


def word_pos(word_map: DataFrame, leaves: DataFrame) -> DataFrame:
    """(conv_id, utt, idx, pos): the tags of the leaves that a word is mapped to, joined in order; ``null`` for words without a leaf.

    ``word_map(conv_id, utt, idx, leaf)`` with one row per mapped leaf (leaf null if none); ``leaves(conv_id, utt, leaf, pos)``.
    """
    joined = word_map.join(leaves, ["conv_id", "utt", "leaf"], "left")
    tags = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("leaf", "pos")))), lambda s: s["pos"]))
    return joined.groupBy("conv_id", "utt", "idx").agg(tags.alias("pos")).withColumn("pos", F.when(F.col("pos") == "", "null").otherwise(F.col("pos")))
