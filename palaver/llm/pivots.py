"""Operator 10: embedding near-duplicates by a pivot-permutation index.

Every vector is described by its nearest pivots (7 of up to 256 pivots, one more for every doubling, so that recall at the threshold holds as lists get finer). The inverted lists
are kept by pairs of pivots, so two vectors
meet in a list exactly when they share at least two pivots; every meeting is verified by the cosine in double precision. A
pair that meets in several lists counts in the list of its two smallest shared pivots only.

The pivots are fitted on a bounded sample: four vectors a pivot, 4,096 at least and ``SAMPLE`` at most, distinct and chosen by hash, from which about
sqrt(number of vectors) pivots, ``MIN_PIVOTS`` at least, are picked by farthest-first traversal. All vectors are indexed.

Equal vectors are one class with a multiplicity. A list of over ``CHUNK`` classes is dealt into cells of two chunks, and every
pair of chunks meets in one cell, so nothing is left out and a task holds 2 * CHUNK vectors at most. Links are counted where they are
found; of a cell's links only a spanning forest is passed on.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing
(n_links 0, component_id = vec_id, kept); a row without vec_id links with nothing either and has component_id and kept null; only vectors of
equal length can link; rows that repeat a vec_id each get a row; an empty table gives no row. Only vec_id and embedding are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, join_counted, materialise, read_table
from .components import connected_components

THRESHOLD = 0.9
NEAREST = 7
#: Vectors that are collected to pick pivots from, at most; so there are no more pivots than this, for about 270 million distinct vectors.
SAMPLE = 16_384
MIN_PIVOTS = 64
CHUNK = 4096
#: Rows of a cell whose similarities are held at a time.
BLOCK = 256
#: Products of vectors and pivots that are held at a time.
PRODUCTS = 1 << 20


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    x = np.asarray(flat, np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal over unit vectors, so that a crowd of near copies gives one pivot."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        at = int(np.argmin(nearest))
        chosen.append(at)
        nearest = np.maximum(nearest, sample @ sample[at])
    return sample[chosen]


def description_length(pivots: int) -> int:
    """Nearest pivots in a description: one more than NEAREST for every doubling of the pivots beyond 256, but not more than there are."""
    return min(pivots, NEAREST + max(0, math.ceil(math.log2(pivots / 256))))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False), dim)


def _assign(classes: DataFrame, pivots: np.ndarray, dim: int, nearest: int) -> DataFrame:
    """classes(cls, n, v) -> also ``near``: the numbers of the nearest pivots, ascending."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PRODUCTS // len(shared.value))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                far = -(_vectors(batch.column(2), dim) @ shared.value.T)
                order = np.argpartition(far, nearest - 1, axis=1)[:, :nearest]
                near = np.sort(order, axis=1).astype(np.int16)
                width = near.shape[1]
                lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, width, dtype=np.int32), near.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["cls", "n", "v", "near"])

    kind = classes.schema["v"].dataType.simpleString()
    return classes.mapInArrow(run, f"cls long, n long, v {kind}, near array<short>")


def _cell_links(key: int, chunk: np.ndarray, ids: np.ndarray, n: np.ndarray, x: np.ndarray, near: np.ndarray, pivots: int, threshold: float):
    """(count ids, counts, edge a, edge b) of one cell. ``chunk`` is 0 or 1; a cell of one chunk compares it with itself."""
    one = not chunk.any()
    left = np.arange(ids.size) if one else np.flatnonzero(chunk == 0)
    right = left if one else np.flatnonzero(chunk == 1)
    first, second = divmod(key, pivots)
    counts, linked = np.zeros(ids.size, np.int64), np.zeros(ids.size, bool)
    for at in range(0, left.size, BLOCK):
        rows = left[at : at + BLOCK]
        i, j = np.nonzero(x[rows] @ x[right].T >= threshold)
        i, j = rows[i], right[j]
        i, j = i[i != j], j[i != j]
        if not i.size:
            continue
        linked[i] = linked[j] = True
        for part in range(0, i.size, 1 << 16):  # count the pair here only if the key is its two smallest shared pivots
            p, q = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            earlier = near[p] < second
            earlier &= near[p] != first
            shared = np.zeros(p.size, bool)
            for k in range(near.shape[1]):
                if earlier[:, k].any():
                    shared |= earlier[:, k] & (near[q] == near[p, k][:, None]).any(axis=1)
            p, q = p[~shared], q[~shared]
            np.add.at(counts, p, n[q])
            if not one:
                np.add.at(counts, q, n[p])
    a, b = [], []
    open_rows = np.flatnonzero(linked)
    while open_rows.size:
        queue = [open_rows[-1]]
        open_rows = open_rows[:-1]
        while queue and open_rows.size:
            here = queue.pop()
            close = x[open_rows] @ x[here] >= threshold
            if close.any():
                found = open_rows[close]
                a.append(np.full(found.size, ids[here]))
                b.append(ids[found])
                queue.extend(found.tolist())
                open_rows = open_rows[~close]
    hit = counts > 0
    none = np.empty(0, np.int64)
    return ids[hit], counts[hit], np.concatenate(a) if a else none, np.concatenate(b) if b else none


def _meet(dealt: DataFrame, dim: int, pivots: int, threshold: float) -> DataFrame:
    """dealt: cell columns (key, lo, hi), chunk, cls, n, v, near; sorted within partitions by cell. -> a, b, n: an edge (n null) or a count (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell = None

        def close() -> pa.RecordBatch | None:
            t = pa.Table.from_batches(held).combine_chunks() if held else None
            if t is None or t.num_rows < 2:
                return None
            col = lambda k: t.column(k).combine_chunks()
            near = col("near")
            near = near.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            ids, counts, a, b = _cell_links(cell[0], col("chunk").to_numpy(zero_copy_only=False), col("cls").to_numpy(zero_copy_only=False), col("n").to_numpy(zero_copy_only=False), _vectors(col("v"), dim), near, pivots, threshold)
            if not ids.size and not a.size:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.r_[ids, a]), pa.array([None] * ids.size + b.tolist(), pa.int64()), pa.array(counts.tolist() + [None] * a.size, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            starts = np.r_[0, 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)), batch.num_rows]
            for at, end in zip(starts[:-1], starts[1:]):
                here = tuple(keys[:, at].tolist())
                if here != cell:
                    out = close()
                    if out:
                        yield out
                    held, cell = [], here
                held.append(batch.slice(at, end - at))
        out = close()
        if out:
            yield out

    return dealt.mapInArrow(run, "a long, b long, n long")


def _links(classes: DataFrame, dim: int, threshold: float, nearest: int | None, chunk: int) -> DataFrame | None:
    """Edges and counts among materialised classes(cls, n, v) of one length."""
    total = classes.count()
    if total < 2:
        return None
    wanted = min(SAMPLE, max(MIN_PIVOTS, math.isqrt(total)))
    sample = [r[0] for r in hash_sample(classes.select("v"), ["v"], min(SAMPLE, max(4096, 4 * wanted)), total).collect()]
    pivots = pick_pivots(unit_rows(np.array(sample, np.float64).ravel(), dim), wanted)
    # with fewer pivots than a description holds, or one pivot only, all vectors meet in one list
    width = min(nearest or description_length(len(pivots)), len(pivots))
    described = materialise(_assign(classes, pivots, dim, width))
    p = len(pivots)
    pairs = list(itertools.combinations(range(width), 2)) or [(0, 0)]
    key = F.explode(F.array(*((F.col("near")[i].cast("long") * F.lit(p) + F.col("near")[j].cast("long")) for i, j in pairs)))
    thin = described.select("cls", key.alias("key"))
    large = materialise(thin.groupBy("key").count().filter(F.col("count") > chunk).select("key", F.ceil(F.col("count") / F.lit(chunk)).cast("long").alias("chunks")))
    if large.isEmpty():
        dealt = described.select(key.alias("key"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("chunk"), "cls", "n", "v", "near")
    else:
        own = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
        cells = thin.join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long"))).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))))
        cells = cells.select("cls", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("chunk"))
        dealt = cells.join(described, "cls").select("key", "lo", "hi", "chunk", "cls", "n", "v", "near")
    ordered = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return _meet(ordered, dim, p, threshold)


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, nearest: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``embeddings(vec_id, embedding)``."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    marked = rows.withColumn("usable", usable)
    good = marked.filter("usable")
    classes = materialise(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("cls", F.monotonically_increasing_id()))
    found = None
    for (dim,) in classes.select(F.size("v")).distinct().collect():
        links = _links(classes.filter(F.size("v") == dim).select("cls", "n", "v"), dim, threshold, nearest, chunk)
        if links is not None:
            found = links if found is None else found.union(links)
    named = classes.select("cls", "id", "n", "v")
    if found is None:
        named = named.select("v", "n", F.col("id").alias("component_id"), (F.col("n") - 1).alias("n_links"))
    else:
        found = materialise(found)
        counts = found.filter("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
        roots = materialise(connected_components(found.filter("b is not null").select("a", "b")))
        names = roots.join(classes.select("cls", "id"), F.col("node") == F.col("cls")).groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("nodes"))
        of = join_counted(roots, materialise(names), ["root"], "nodes").select(F.col("node").alias("cls"), "least")
        named = named.join(counts, "cls", "left").join(of, "cls", "left").select("v", "n", F.coalesce("least", "id").alias("component_id"), (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("n_links"))
    linked = join_counted(good.select("vec_id", "v"), materialise(named), ["v"], "n").select("vec_id", "n_links", "component_id")
    alone = marked.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def brute_force(rows: list[tuple[int, list | None]], threshold: float = THRESHOLD) -> dict[int, tuple[int, int]]:
    """vec_id -> (n_links, component_id) over all pairs."""
    good = {k: np.array(v, float) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    root, links = {k: k for k, _ in rows}, {k: 0 for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(good), 2):
        x, y = good[a], good[b]
        if x.size == y.size and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
            links[a] += 1
            links[b] += 1
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {k: (links[k], find(k)) for k in root}


#: All pairs and what they reach: for small tables. It is exact, as the index is where its recall is 1.
ORACLE = f"""
WITH RECURSIVE ok AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
pair AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= {THRESHOLD}),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings WHERE vec_id IS NOT NULL UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY 1)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least.component_id, e.vec_id = least.component_id AS kept FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN least USING (vec_id)"""
