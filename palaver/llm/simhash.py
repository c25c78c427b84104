"""Operator 8: SimHash near-duplicates. Pigeonhole blocks find candidates, the Hamming distance decides.

A fingerprint is cut into blocks; two fingerprints that are close agree on whole blocks. Equal contents of the blocks of a table are a bucket; within a bucket all
distinct fingerprints are compared, but only a spanning forest of the links leaves it, so output grows with the number
of fingerprints and not with the pairs. Documents of one fingerprint are one node from the start. Two schemes:

* ``CLOSE``: 64 bits over 4-word shingles, links at 4 or fewer differing bits. A table keeps all but 4 of the blocks, in every choice, so every link shares a
  bucket: exact.
* ``SIMILAR``: links at a Jaccard similarity of 0.8 or more of 5-word shingles, and at no less. Fingerprints of texts at that similarity differ in about 15 of 100
  bits, too many to tell from 64, so there are 256, and candidates are at ``angle_bits(0.8)`` bits plus two standard deviations. The fingerprint is
  split into blocks after each of several fixed shuffles of its bits, and a table is one block: a candidate shares one with the probabilities that ``chance`` gives.
  Texts are one node only if their sets of shingles are the same. A bucket gives a forest of least distances, and ``verified`` compares the sets of shingles of what it
  gives: each node's closest candidate first, then the candidates between what these left apart.

A bucket of over ``limit`` distinct fingerprints is handed on whole and cut again into longer keys. No bucket is cut off; at the last level any is compared whole. Fingerprints
that very many documents hold are joined without one task getting them all (``common.join_counted``).

Defined results: null and empty texts have fingerprint zero and link like any other; very long texts are hashed whole; rows that repeat a doc_id each get
a row; a null doc_id is carried through and never is a component's name unless the component has no other; an empty table
gives no row. Only id and text (and the named row column) are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import join_counted, join_narrow, materialise, read_table, texts, written
from .components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Hashes that are looked at together.
READ_HASHES = 200_000
#: Pairs of a bucket whose distances are held at a time.
PAIRS = 1 << 20


class Scheme(NamedTuple):
    """How texts become fingerprints of 64 * ``words`` bits, at how many differing bits they link, the bit masks (a row of ``words`` a table) of every level, how
    many fingerprints a bucket may hold before it is cut again, and the Jaccard similarity of shingles that links must have (0: the bits decide)."""

    shingle: int
    words: int
    radius: int
    levels: tuple[np.ndarray, ...]
    limit: int
    similarity: float = 0.0

    @property
    def columns(self) -> list[str]:
        return [f"f{i}" for i in range(self.words)]

    @property
    def node(self) -> list[str]:
        """Columns that texts of one node agree in: the fingerprint and, where similarity is verified, a digest of the set of shingles."""
        return [*self.columns, "s"] if self.similarity else self.columns


def all_choices(blocks: int, radius: int = RADIUS) -> np.ndarray:
    """Masks of 64 bits for all choices of ``blocks - radius`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return np.array([[sum(c)] for c in itertools.combinations(masks, blocks - radius)], np.uint64)


def shuffled_blocks(words: int, bits: int, shuffles: int) -> np.ndarray:
    """Masks of the blocks of ``bits`` bits after each of the shuffles."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(shuffles):
        order = rng.permutation(64 * words)
        for at in range(0, order.size - bits + 1, bits):
            mask = np.zeros(64 * words, np.uint8)
            mask[order[at : at + bits]] = 1
            out.append(np.packbits(mask, bitorder="little").view(np.uint64))
    return np.array(out)


def angle_bits(similarity: float, bits: int) -> float:
    """Expected number of differing bits for two sets of one size at a Jaccard similarity: the angle between their vectors."""
    return bits * math.acos(2 * similarity / (1 + similarity)) / math.pi


def chance(distance: int, bits: int, block: int, shuffles: int) -> float:
    """Probability that fingerprints at a distance share a block."""
    alike = math.comb(bits - block, distance) / math.comb(bits, distance)
    return 1 - (1 - alike) ** (shuffles * (bits // block))


def similar(similarity: float = 0.8, shingle: int = 5, words: int = 4) -> Scheme:
    bits = 64 * words
    mean = angle_bits(similarity, bits)
    radius = int(mean + 2 * math.sqrt(mean * (1 - mean / bits)))
    return Scheme(shingle, words, radius, tuple(shuffled_blocks(words, b, s) for b, s in ((16, 4), (24, 16), (32, 64))), 4_000, similarity)


#: Blocks a fingerprint is cut into, level by level; a table keeps all but RADIUS of them.
LEVELS = (6, 8, 12, 16)
CLOSE = Scheme(SHINGLE, 1, RADIUS, tuple(all_choices(n) for n in LEVELS), 50_000)
SIMILAR = similar()


_LANES = np.uint64(0x0101010101010101)
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 of the shingles, repeats included."""
    words = text.lower().split()
    if len(words) <= shingle:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    return [xxh64_intdigest(joined[i : j - 1], SEED) for i, j in zip([0, *ends], ends[shingle - 1 :])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of hashes of the given sizes (not 0), the bits set in over half of each run."""
    starts = np.cumsum(sizes) - sizes
    # the eight bits of each byte lane are counted one after another; a lane counts to 255
    blocks = -(-sizes // 255)
    first = np.cumsum(blocks) - blocks
    begins = np.repeat(starts, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    bits = np.empty((sizes.size, 64), bool)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, begins)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits[:, shift::8] = 2 * counts > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint_rows(hashes: list[list[int]], words: int) -> np.ndarray:
    """A row of ``words`` fingerprint words for every list of hashes; the first word is the SimHash of the hashes themselves."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros((sizes.size, words), np.uint64)
    some = np.flatnonzero(sizes)
    if some.size:
        flat = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, int(sizes.sum()))
        for word in range(words):
            out[some, word] = majority(_mix(flat + np.uint64(word * int(_GOLDEN) % 2**64)) if word else flat, sizes[some])
    return out


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return int(fingerprint_rows([shingle_hashes(text, shingle)], 1)[0, 0])


def fingerprints(docs: DataFrame, scheme: Scheme = CLOSE, row: str | None = None) -> DataFrame:
    """doc_id, the scheme's columns of a node (signed longs) and the long column ``row``, if one is named, for each row of ``docs(doc_id, text)``."""
    carried = [row] if row else []
    names = ["doc_id", *scheme.node, *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, held, at = [], 0, 0
            for text in texts(batch.column(1)):
                hashes.append(shingle_hashes(text, scheme.shingle))
                held += len(hashes[-1])
                if held >= READ_HASHES or at + len(hashes) == batch.num_rows:
                    found = fingerprint_rows(hashes, scheme.words).view(np.int64)
                    if scheme.similarity:
                        digests = np.array([xxh64_intdigest(np.unique(np.array(h, np.uint64)).tobytes(), SEED) for h in hashes], np.uint64)
                        found = np.column_stack([found, digests.view(np.int64)])
                    here = slice(at, at + len(hashes))
                    columns = [c.slice(here.start, len(hashes)) for c in (batch.column(0), *(batch.column(2 + i) for i in range(len(carried))))]
                    yield pa.RecordBatch.from_arrays([columns[0], *(pa.array(found[:, i].copy()) for i in range(found.shape[1])), *columns[1:]], names=names)
                    hashes, held, at = [], 0, here.stop

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (row numbers) of the links among fingerprints, by searching outward from one after another."""
    step = max(1, PAIRS // max(1, len(prints)))
    linked = np.concatenate([(distances(prints[i : i + step, None], prints[None]) <= radius).sum(axis=1) > 1 for i in range(0, len(prints), step)]) if len(prints) else np.zeros(0, bool)
    left, a, b = np.flatnonzero(linked), [], []
    while left.size:
        queue, left = [left[-1]], left[:-1]
        while queue and left.size:
            here = queue.pop()
            near = distances(prints[left], prints[here]) <= radius
            if near.any():
                found = left[near]
                a.append(np.full(found.size, here))
                b.append(found)
                queue.extend(found.tolist())
                left = left[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def nearest_forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (row numbers) of the links among fingerprints with the least sum of distances: at any smaller radius, its links of that radius connect what all such links do."""
    left = np.arange(1, len(prints))
    best, via = np.full(left.size, 64 * prints.shape[1] + 1), np.zeros(left.size, np.int64)
    here, a, b = 0, [], []
    while left.size:
        found = distances(prints[left], prints[here])
        closer = found < best
        best[closer], via[closer] = found[closer], here
        at = int(best.argmin())
        here = int(left[at])
        if best[at] <= radius:
            a.append(int(via[at]))
            b.append(here)
        keep = np.arange(left.size) != at
        left, best, via = left[keep], best[keep], via[keep]
    return np.array(a, np.int64), np.array(b, np.int64)


def _links(keys: np.ndarray, prints: np.ndarray, radius: int, search=forest) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) within whole buckets; rows are sorted by key. Small buckets are compared all at once by their distance in rows."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, keys.size])
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 8), sizes))
    for d in range(1, 8):
        if small.size <= d:
            break
        x, y = small[:-d], small[d:]
        same = keys[x] == keys[y]
        x, y = x[same], y[same]
        near = distances(prints[x], prints[y]) <= radius
        a.append(x[near])
        b.append(y[near])
    for start, n in zip(starts[sizes > 8], sizes[sizes > 8]):
        x, y = search(prints[start : start + n], radius)
        a.append(start + x)
        b.append(start + y)
    return np.concatenate(a), np.concatenate(b)


def _bucket_links(classes: DataFrame, scheme: Scheme, level: int) -> DataFrame:
    """a, b, over: links of classes(cls, fingerprint columns), or (over) the key and the class of every row of a bucket over the limit. Where similarity is verified also
    ``d``, the number of differing bits."""
    masks = scheme.levels[level]
    search = nearest_forest if scheme.similarity else forest
    last = level == len(scheme.levels) - 1
    prints = lambda batch, at: np.stack([batch.column(at + i).to_numpy(zero_copy_only=False) for i in range(scheme.words)], axis=1).view(np.uint64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                f = prints(batch, 1)
                out = np.empty((len(f), len(masks)), np.uint64)
                for table, mask in enumerate(masks):
                    key = np.full(len(f), table, np.uint64)
                    for word in range(scheme.words):
                        key = _mix(key + _GOLDEN + (f[:, word] & mask[word]))
                    out[:, table] = key
                lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, len(masks), dtype=np.int32), out.ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays([lists, *batch.columns], names=["keys", *batch.schema.names])

    longs = ", ".join(f"{c} long" for c in ["cls", *scheme.columns])
    keyed = classes.select("cls", *scheme.columns).mapInArrow(keys, f"keys array<long>, {longs}")
    dealt = keyed.select(F.explode("keys").alias("key"), "cls", *scheme.columns).repartition("key").sortWithinPartitions("key", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        held_k, held_c, held_f, over = none, none, np.empty((0, scheme.words), np.uint64), None

        def out(a: np.ndarray, b: np.ndarray, is_over: bool, d: np.ndarray | None = None) -> pa.RecordBatch:
            columns = {"a": pa.array(a), "b": pa.array(b), "over": pa.array(np.full(a.size, is_over))}
            return pa.RecordBatch.from_pydict(columns | ({"d": pa.array(np.zeros(a.size, np.int64) if d is None else d)} if scheme.similarity else {}))

        def linked(k: np.ndarray, c: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = _links(k, f, scheme.radius, search)
            if a.size:
                yield out(c[a], c[b], False, distances(f[a], f[b]) if scheme.similarity else None)

        for batch in batches:
            k, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            f = prints(batch, 2)
            if over is not None:  # the rest of a bucket that is handed on
                same = k == over
                if same.any():
                    yield out(k[same], c[same], True)
                if same.all():
                    continue
                over, k, c, f = None, k[~same], c[~same], f[~same]
            k, c, f = np.concatenate([held_k, k]), np.concatenate([held_c, c]), np.concatenate([held_f, f])
            cut = int(np.searchsorted(k, k[-1])) if k.size else 0
            if cut:
                yield from linked(k[:cut], c[:cut], f[:cut])
            held_k, held_c, held_f = k[cut:], c[cut:], f[cut:]
            if not last and held_k.size > scheme.limit:
                yield out(held_k, held_c, True)
                over, held_k, held_c, held_f = held_k[0], none, none, held_f[:0]
        yield from linked(held_k, held_c, held_f)

    return dealt.mapInArrow(run, "a long, b long, over boolean" + (", d long" if scheme.similarity else ""))


def link_forest(classes: DataFrame, scheme: Scheme = CLOSE) -> DataFrame:
    """Edges (a, b, and d where similarity is verified) among materialised classes(cls, fingerprint columns) that connect what all links found connect."""
    edges, here = None, classes
    for level in range(len(scheme.levels)):
        found = materialise(_bucket_links(here, scheme, level))
        mine = found.filter(~F.col("over")).drop("over")
        edges = mine if edges is None else edges.union(mine)
        if found.filter("over").isEmpty():
            break
        here = materialise(classes.join(found.filter("over").select(F.col("b").alias("cls")).distinct(), "cls"))
    return edges


#: Bytes of shingle sets that are written together.
SET_BYTES = 1 << 22
#: Comparisons a text's set is listed for in one row.
LISTED = 100_000


def shingle_sets(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """(pair, shingles) for rows(row, text, pairs): the sorted distinct hashes of the text's shingles, once for every entry of ``pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shingles, pairs, sets, held = None, b"", [], [], 0
        for batch in batches:
            for row, text, of in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2)):
                if row != last:
                    last, shingles = row, np.unique(np.array(shingle_hashes(text, scheme.shingle), np.uint64)).tobytes()
                for pair in of.values.to_numpy(zero_copy_only=False).tolist():
                    pairs.append(pair)
                    sets.append(shingles)
                    held += len(shingles) + 16
                    if held >= SET_BYTES:
                        yield pa.RecordBatch.from_pydict({"pair": pa.array(pairs, pa.int64()), "shingles": pa.array(sets, pa.binary())})
                        pairs, sets, held = [], [], 0
        if pairs:
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pairs, pa.int64()), "shingles": pa.array(sets, pa.binary())})

    return rows.mapInArrow(run, "pair long, shingles binary")


def are_similar(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sorted sets of 64-bit hashes have the similarity; two empty sets have it."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if min(x.size, y.size) < similarity * max(x.size, y.size):
        return False
    union = np.union1d(x, y).size
    return x.size + y.size - union >= similarity * union


def similar_pairs(pairs: DataFrame, docs: DataFrame, row: str, scheme: Scheme) -> DataFrame:
    """The rows (a, b) of materialised pairs(a, b, row_a, row_b) whose texts, rows of ``docs(row, text)``, have the scheme's similarity. A pair's two sets meet by its number, so no text
    is a hot key however many pairs it has."""
    numbered = materialise(pairs.withColumn("pair", F.monotonically_increasing_id()))
    count = numbered.count()
    ends = numbered.select(F.explode(F.array("row_a", "row_b")).alias(row), "pair")
    lists = ends.groupBy(row, F.pmod("pair", F.lit(1 + 2 * count // LISTED)).alias("part")).agg(F.collect_list("pair").alias("pairs")).drop("part")
    rows = join_narrow(docs.select(row, F.col("text").cast("string").alias("text")), lists, [row], "inner", 2 * count)
    met = shingle_sets(rows.select(row, "text", "pairs"), scheme).repartition("pair").sortWithinPartitions("pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, bytes] = {}
        for batch in batches:
            same = []
            for pair, shingles in zip(batch.column(0).to_pylist(), batch.column(1)):
                other = waiting.pop(pair, None)
                if other is None:
                    waiting[pair] = shingles.as_py()
                elif are_similar(other, shingles.as_py(), scheme.similarity):
                    same.append(pair)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(same, pa.int64())})

    return numbered.join(met.mapInArrow(run, "pair long"), "pair").select("a", "b")


def verified(links: DataFrame, classes: DataFrame, docs: DataFrame, row: str, scheme: Scheme) -> DataFrame:
    """Edges (a, b) that connect what the links(a, b, d) of the scheme's similarity connect; classes(cls, row) name a row of each class.

    Every class's link of least distance is compared first. Of the others only those are compared that lead from one component of these to another, so
    a large group costs about a comparison a text.
    """
    links = written(links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d")).filter("a <> b"))
    both = links.union(links.select("b", "a", "d"))
    closest = both.groupBy(F.col("a").alias("cls")).agg(F.min(F.struct("d", "b")).alias("near"), F.count(F.lit(1)).alias("links"))
    nodes = written(closest.join(classes.select("cls", F.col(row).alias("at")), "cls"))

    def placed(pairs: DataFrame) -> DataFrame:
        of = lambda side: nodes.select(F.col("cls").alias(side), F.col("at").alias(f"row_{side}"), "links")
        first = join_counted(pairs.select("a", "b"), of("a"), ["a"], "links").drop("links")
        return join_counted(first, of("b"), ["b"], "links").select("a", "b", "row_a", "row_b")

    best = nodes.select(F.least("cls", "near.b").alias("a"), F.greatest("cls", "near.b").alias("b")).distinct()
    first = written(similar_pairs(placed(best), docs, row, scheme))
    roots = written(connected_components(first))
    known = written(nodes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "links"))
    of = lambda side: known.select(F.col("cls").alias(side), F.col("root").alias(f"root_{side}"), "links")
    apart = join_counted(join_counted(links.select("a", "b"), of("a"), ["a"], "links").drop("links"), of("b"), ["b"], "links").filter("root_a <> root_b")
    second = similar_pairs(placed(written(apart.select("a", "b").join(best, ["a", "b"], "left_anti"))), docs, row, scheme)
    return written(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second))


def near_duplicates(docs: DataFrame, scheme: Scheme = CLOSE, row: str | None = None) -> DataFrame:
    """doc_id, the scheme's fingerprint columns and component_id for each row of ``docs(doc_id, text)``. With ``row``, the name of a long column, also that column and root:
    a number for every component, which tells apart components of one name or none. A scheme that verifies similarity needs ``row``, a number of its own for each row."""
    if scheme.similarity and not row:
        raise ValueError("rows need numbers for their similarity to be verified")
    thin = materialise(fingerprints(docs, scheme, row))
    prints = scheme.node
    named_row = [F.min(row).alias(row)] if scheme.similarity else []
    classes = materialise(thin.groupBy(*prints).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), *named_row).withColumn("cls", F.monotonically_increasing_id()))
    if scheme.similarity:
        links = verified(link_forest(classes, scheme), classes, docs, row, scheme)
        classes = classes.drop(row)
    else:
        links = link_forest(classes, scheme)
    roots = materialise(connected_components(links))
    of = roots.join(classes.select("cls", "first"), F.col("node") == F.col("cls"))
    names = of.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    named = join_counted(roots, materialise(names), ["root"], "nodes").select(F.col("node").alias("cls"), "root", "component_id")
    full = classes.join(named, "cls", "left").select(*prints, "n", F.coalesce("root", "cls").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    return join_counted(thin, materialise(full), prints, "n").select("doc_id", *prints, "component_id", *([row, "root"] if row else []))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text")))


def brute_force(rows: list[tuple[int, str | None]], radius: int = RADIUS) -> dict[int, tuple[str, int]]:
    """doc_id -> (fingerprint, component_id) by plain loops over bits and over all pairs."""
    fps = {}
    for doc_id, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        shingles = [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []
        h = [xxh64_intdigest(s.encode(), SEED) for s in shingles]
        fps[doc_id] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for x, y in itertools.combinations(sorted(fps), 2):
        if (fps[x] ^ fps[y]).bit_count() <= radius:
            a, b = sorted((find(x), find(y)))
            root[b] = a
    return {d: (f"{fps[d]:016x}", find(d)) for d in fps}
