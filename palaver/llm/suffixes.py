"""Operator 9: repeated passages by a sparse suffix array.

Only suffixes at minimiser positions are kept. Every window of ``MIN_WORDS`` words belongs to one position in it: the leftmost of
its ``GRAM``-word grams with the smallest hash. That depends on the window's words alone, so equal windows have their position at the same
offset, and to find all repeated windows it is enough to look around the positions that own them.

1. *Keys.* A position that owns windows which start at most ``HALF`` words before it has a key over the words that all of these share, and
   likewise for windows that start further to the left (``MIN_WORDS - HALF`` = 30 and 31 words). Keys are counted; positions of keys that
   occur once are out of the race without ever carrying text.
2. *Suffixes.* For the positions left, the words to the right of the position and, read backwards, the words to its left are cut out of the
   text. Suffixes of one key are sorted by their right words; the common prefix of sorted neighbours (in words) says how far
   any two agree to the right, the same on the sorted left contexts how far to the left. Windows whose two extents together reach ``MIN_WORDS`` are
   repeats. Words are compared as they are, no hash decides.
3. Spans of one document that overlap or touch are joined, which extends a match to its true ends.

Skew: equal texts are one text with a multiplicity. A key with over ``GROUP_ROWS`` positions never becomes a group in a
task: its windows are written out as 128-bit digests (two independent 64-bit hashes; two different windows pass for equal with probability 2^-128) and counted by Spark with
map-side sums. Joins on a key send the at most ``HEAVY_KEYS`` keys with the most rows to all tasks (``common.join_counted``).

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

Defined results: null, empty and short texts have no passages; a passage that repeats within one document counts, as does one of a document that
is there twice; rows that repeat a doc_id are documents of their own; null doc_ids are carried through, and ``first_doc_id`` is the smallest that is not null;
a very long text gives more rows, never a larger one than its own; an empty table gives no row. Only id and text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from .common import in_pieces, join_counted, materialise, mix_bits, read_table, run_hashes, texts, words_in

MIN_WORDS = 50
GRAM = 10
#: Windows that start at most this many words before their position have one key, the others another.
HALF = (MIN_WORDS - GRAM) // 2
#: Positions of one key that are compared in one task.
GROUP_ROWS = 100_000
#: Suffixes that are compared at a time, if their groups allow it.
COMPARE_ROWS = 20_000
#: Bytes of text that are looked at together.
READ_BYTES = 2 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_NO_DOC = np.iinfo(np.int64).max


def _hash_runs(words: np.ndarray, starts: np.ndarray | int, length: int) -> np.ndarray:
    """One hash for each run of ``length`` word hashes from ``starts``, or from each of the first ``starts`` words."""
    size = starts if isinstance(starts, int) else starts.size
    total = np.zeros(size, np.uint64)
    for i in range(length):
        total *= _ODD
        total += words[i : i + size] if isinstance(starts, int) else words[starts + i]
    return mix_bits(total)


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in every ``width`` consecutive ones."""
    pick = lambda a, b: np.where(values[a] <= values[b], a, b)
    n, span, r = values.size - width + 1, 1, np.arange(values.size)
    while 2 * span <= width:
        r = pick(r[: r.size - span], r[span:])
        span *= 2
    return pick(r[:n], r[width - span : width - span + n])


def owners(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, fewest, most words by which the windows that a position owns start before it) for the word hashes of texts laid end to end;
    ``text`` numbers the text of every word."""
    if words.size < MIN_WORDS:
        return (np.empty(0, np.int64),) * 3
    grams = _hash_runs(words, words.size - GRAM + 1, GRAM)
    inside = np.flatnonzero(text[: 1 - MIN_WORDS] == text[MIN_WORDS - 1 :])
    owner = _leftmost_least(grams, MIN_WORDS - GRAM + 1)[inside]
    if not owner.size:
        return (np.empty(0, np.int64),) * 3
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1)])
    last = np.r_[first[1:], owner.size] - 1
    return owner[first], owner[first] - inside[last], owner[first] - inside[first]


def word_hashes(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of every word of the texts."""

    def run(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        letters, sizes, text = words_in([t.lower() for t in pieces])
        return run_hashes(letters, sizes), text

    return in_pieces(texts_, run)


#: A place is the position, the fewest and the most words to its left, and the half, in one long.
_PLACE_BITS = 6


def _place(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (at << (2 * _PLACE_BITS)) | (low << _PLACE_BITS) | high


def _split(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << _PLACE_BITS) - 1
    return place >> (2 * _PLACE_BITS), (place >> _PLACE_BITS) & mask, place & mask


def places(docs: DataFrame) -> DataFrame:
    """key, id1, id2, place for every kept position and half of ``docs(id1, id2, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, rows: list[int], held: list[bytes]) -> pa.RecordBatch:
            hashes, text = word_hashes(held)
            at, low, high = owners(hashes, text)
            begins = np.searchsorted(text, np.arange(len(held)))
            near, far = low <= HALF, high > HALF
            keys = np.concatenate([_hash_runs(hashes, at[near], MIN_WORDS - HALF), ~_hash_runs(hashes, at[far] - (HALF + 1), GRAM + HALF + 1)])
            of = np.concatenate([text[at[near]], text[at[far]]])
            place = np.concatenate([_place(at[near], low[near], np.minimum(high[near], HALF)), _place(at[far], np.maximum(low[far], HALF + 1), high[far])])
            index = pa.array(np.array(rows, np.int64)[of])
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).take(index), batch.column(1).take(index), pa.array(place - (begins[of] << (2 * _PLACE_BITS)))], names=["key", "id1", "id2", "place"])

        for batch in batches:
            rows, held, size = [], [], 0
            for row, text in enumerate(texts(batch.column(2))):
                if len(text) >= 2 * MIN_WORDS - 1:
                    rows.append(row)
                    held.append(text)
                    size += len(text)
                if size >= READ_BYTES:
                    yield made(batch, rows, held)
                    rows, held, size = [], [], 0
            if rows:
                yield made(batch, rows, held)

    return docs.select("id1", "id2", "text").mapInArrow(run, "key long, id1 long, id2 long, place long")


def _around(rows: DataFrame, cut, schema: str) -> DataFrame:
    """Rows (id1, id2, doc_id, n, text, wanted) spread to the rows of ``schema`` that ``cut(words, keys, places)`` gives for each text; its columns
    id1, id2, doc_id and n are carried."""
    names = [f.split()[0] for f in schema.split(", ")]
    carried = ["id1", "id2", "doc_id", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(5)
            flat, ends = wanted.flatten(), np.cumsum(np.diff(wanted.offsets.to_numpy())).tolist()
            key, place = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            row, columns, read, at = [], [], 0, 0
            for i, (text, end) in enumerate(zip(texts(batch.column(4)), ends)):
                columns.append(cut(text.lower().split(), key[at:end], place[at:end]))
                row.append(np.full(len(columns[-1][0]), i))
                read, at = read + len(text), end
                if read >= READ_BYTES or end == ends[-1]:
                    index = pa.array(np.concatenate(row))
                    new = iter([pa.array(list(itertools.chain.from_iterable(c)), pa.binary()) if isinstance(c[0], list) else pa.array(np.concatenate(c)) for c in zip(*columns)])
                    yield pa.RecordBatch.from_arrays([batch.column(carried.index(c)).take(index) if c in carried else next(new) for c in names], names=names)
                    row, columns, read = [], [], 0

    return rows.select(*carried, "text", "wanted").mapInArrow(run, schema)


_SUFFIXES = "key long, id1 long, id2 long, doc_id long, n long, place long, right binary, left binary"


def _contexts(words: list[bytes], key: np.ndarray, place: np.ndarray) -> tuple:
    """Right words, and left words read backwards, as far as the windows of a place reach; a blank behind each word keeps sorted order that of the words."""
    right, left = [], []
    for p, low, high in zip(*(x.tolist() for x in _split(place))):
        right.append(b" ".join(words[p : p - low + MIN_WORDS]) + b" ")
        left.append(b" ".join(words[p - high : p][::-1]) + b" " if high else b"")
    return key, place, right, left


_WINDOWS = "id1 long, id2 long, doc_id long, n long, start long, w1 long, w2 long"


def _windows(words: list[bytes], key: np.ndarray, place: np.ndarray) -> tuple:
    """Start and 128-bit digest of every window that the places own."""
    at, low, high = _split(place)
    size = high - low + 1
    starts = np.repeat(at - high, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    hashes = (np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)) for seed in (0, 1))
    return starts, *(_hash_runs(h, starts, MIN_WORDS).view(np.int64) for h in hashes)


def _ids(contexts: list[bytes], width: int) -> np.ndarray:
    """Word numbers of the contexts, a row each, filled up with -1."""
    known: dict[bytes, int] = {}
    out = np.full((len(contexts), width), -1, np.int32)
    for i, c in enumerate(contexts):
        words = c.split()
        out[i, : len(words)] = [known.setdefault(w, len(known)) for w in words]
    return out


def _agree(rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Common prefix of every row with the one before it; -1 where the key changes."""
    same = rows[1:] == rows[:-1]
    common = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1)) if rows.shape[1] else np.zeros(len(rows) - 1, np.int64)
    return np.r_[-1, np.where(key[1:] == key[:-1], common, -1)]


def repeats(key: np.ndarray, n: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, right: list[bytes], left: list[bytes]):
    """(rows, fewest, most words to the left of the position, smallest doc) of the repeated windows of whole groups sorted by key and right words."""
    rows = key.size
    to_right = _agree(_ids(right, MIN_WORDS), key)
    order = np.array([i for *_, i in sorted(zip(key.tolist(), left, range(rows)))], np.int64)
    to_left = _agree(_ids([left[i] for i in order], MIN_WORDS - GRAM), key[order])
    least, most, first = np.full(rows, MIN_WORDS), np.full(rows, -1), np.full(rows, _NO_DOC)
    side = np.empty(rows, np.int64)
    for offset in range(int(low.min()), int(high.max()) + 1):
        mine = np.flatnonzero((low <= offset) & (offset <= high))
        if not mine.size:
            continue
        # rows of one run agree on MIN_WORDS - offset words to the right, rows of one side on offset words to the left
        run = np.cumsum(to_right < MIN_WORDS - offset)
        side[order] = np.cumsum(to_left < offset)
        both = run[mine] * (rows + 1) + side[mine]
        at = np.argsort(both, kind="stable")
        mine, both = mine[at], both[at]
        begins = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        sizes = np.diff(np.r_[begins, both.size])
        several = np.repeat(np.add.reduceat(n[mine], begins) > 1, sizes)
        holder = np.repeat(np.minimum.reduceat(doc[mine], begins), sizes)
        hit = mine[several]
        least[hit] = np.minimum(least[hit], offset)
        most[hit] = np.maximum(most[hit], offset)
        first[hit] = np.minimum(first[hit], holder[several])
    hit = np.flatnonzero(most >= 0)
    return hit, least[hit], most[hit], first[hit]


_SPANS = "id1 long, id2 long, start long, end long, first_doc long"


def _compare(dealt: DataFrame) -> DataFrame:
    """Spans from suffixes sorted by key and right words; a key's suffixes are at most ``GROUP_ROWS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch | None:
            parts = [p for p in held if p.num_rows]
            held.clear()
            if not parts:
                return None
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            col = lambda name: t.column(t.schema.get_field_index(name))
            at, low, high = _split(col("place").to_numpy(zero_copy_only=False))
            doc = col("doc_id").fill_null(_NO_DOC).to_numpy(zero_copy_only=False)
            hit, least, most, first = repeats(col("key").to_numpy(zero_copy_only=False), col("n").to_numpy(zero_copy_only=False), doc, low, high, col("right").to_pylist(), col("left").to_pylist())
            if not hit.size:
                return None
            index = pa.array(hit)
            carried = [col(c).take(index) for c in ("id1", "id2")]
            return pa.RecordBatch.from_arrays([*carried, pa.array(at[hit] - most), pa.array(at[hit] - least + MIN_WORDS), pa.array(first, mask=first == _NO_DOC)], names=[f.split()[0] for f in _SPANS.split(", ")])

        for whole in batches:
            for start in range(0, whole.num_rows, COMPARE_ROWS):
                batch = whole.slice(start, COMPARE_ROWS)
                key = batch.column(0).to_numpy(zero_copy_only=False)
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if cut or (held and held[-1].column(0)[-1].as_py() != int(key[0])):
                    held.append(batch.slice(0, cut))
                    out = close()
                    if out:
                        yield out
                held.append(batch.slice(cut))
        out = close()
        if out:
            yield out

    return dealt.mapInArrow(run, _SPANS)


def _counted_windows(rows: DataFrame) -> DataFrame:
    """Spans from all windows of the places of very common keys, counted by their digests."""
    every = materialise(_around(rows, _windows, _WINDOWS))
    counts = every.groupBy("w1", "w2").agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first_doc"))
    found = join_counted(every.drop("doc_id", "n"), materialise(counts.filter("copies > 1").drop("copies")), ["w1", "w2"], "rows")
    return found.select("id1", "id2", "start", (F.col("start") + MIN_WORDS).alias("end"), "first_doc")


def repeated_passages(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, first_doc_id: every longest span of ``docs(doc_id, text)`` that is made of repeated
    stretches of MIN_WORDS words. first_doc_id: the smallest doc_id that holds a stretch of the span."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = rows.select(F.xxhash64("text").alias("id1"), F.xxhash64(F.lit(MIN_WORDS), "text").alias("id2"), "doc_id", "text")
    same = ["id1", "id2"]
    kept = places(rows)
    counts = kept.groupBy("key").agg(F.count(F.lit(1)).alias("positions"))
    wanted = join_counted(kept, materialise(counts.filter("positions > 1")), ["key"], "positions")
    listed = wanted.groupBy(*same).agg(*(F.sort_array(F.collect_set(F.when(mine, F.struct("key", "place")))).alias(name) for name, mine in (("small", F.col("positions") <= group_rows), ("large", F.col("positions") > group_rows))))
    listed = materialise(listed)
    # texts that are equal are one text n times over
    distinct = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    suffixes = _around(distinct.join(listed.filter(F.size("small") > 0).select(*same, F.col("small").alias("wanted")), same), _contexts, _SUFFIXES)
    spans = _compare(suffixes.repartition("key").sortWithinPartitions("key", "right"))
    large = listed.filter(F.size("large") > 0).select(*same, F.col("large").alias("wanted"))
    if not large.isEmpty():
        few = rows.join(large.select(*same), same, "left_semi").groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
        spans = spans.unionByName(_counted_windows(few.join(large, same)))
    along = Window.partitionBy(*same).orderBy("start", "end")
    islands = spans.withColumn("new", F.when(F.col("start") <= F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)).withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy(*same, "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("first_doc").alias("first_doc_id"))
    found = joined.groupBy(*same).agg(F.collect_list(F.struct("start_word", "end_word", "first_doc_id")).alias("spans"))
    holders = rows.select(*same, "doc_id")
    copies = holders.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    each = join_counted(holders, materialise(found.join(copies, same)), same, "n").select("doc_id", F.explode("spans").alias("span")).select("doc_id", "span.*")
    return each.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def brute_force(rows: list[tuple[int, str | None]], min_words: int = MIN_WORDS) -> set[tuple[int, int, int]]:
    """(doc_id, start, end) from all stretches of all texts."""
    places: dict[tuple, list] = {}
    for row, (_, text) in enumerate(rows):
        words = (text or "").encode().lower().split()
        for i in range(len(words) - min_words + 1):
            places.setdefault(tuple(words[i : i + min_words]), []).append((row, i))
    hit: dict[int, set] = {}
    for where in places.values():
        if len(where) > 1:
            for row, i in where:
                hit.setdefault(row, set()).add(i)
    out = set()
    for row, starts in hit.items():
        begin = end = None
        for i in sorted(starts):
            if end is None or i > end:
                if end is not None:
                    out.add((rows[row][0], begin, end))
                begin = i
            end = i + min_words
        out.add((rows[row][0], begin, end))
    return out
