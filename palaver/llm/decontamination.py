"""Operator 1: benchmark decontamination with one Aho-Corasick automaton over normalised benchmark items.

Every window of ``WINDOW`` consecutive words of an item holds a whole block of ``WINDOW // 2`` words that starts at a multiple of that in
the item. So the automaton's patterns are these blocks, and items shorter than a window as a whole: about one node a benchmark word instead of one for every word of every
window. Where a block occurs in a document, the match is extended left and right along the item; if it reaches ``WINDOW`` words, all windows in it occur there.

Texts are scanned once. One automaton may hold ``PASS_BYTES`` of benchmark text, counted before any of it leaves the executors; of a larger
benchmark each further part is another scan that brings back hits only, joined to the first by id and hash and length of the text. Nothing is left out.

Defined results: null and empty texts have no words and are clean; very long texts are scanned whole; an item without words never occurs; items with equal
text are reported together; overlapping hits are merged; rows that repeat a doc_id each get their own result; a null doc_id is carried through; an
empty benchmark leaves every document clean; an empty table gives no row; item ids that are null are named ``null``. Only the id and text columns
are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialise, read_table, texts
from .phrases import PhraseAutomaton, word_offsets, words_of

WINDOW = 10
#: Bytes of benchmark text in one automaton: about 20 bytes of memory a byte.
PASS_BYTES = 16 << 20

SCAN_SCHEMA = "doc_id long, n_words long, hits array<struct<first:long,end:long>>, item_ids array<string>, spans array<struct<start:long,end:long>>"


_pairs = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", _pairs("first", "end")), ("item_ids", pa.list_(pa.string())), ("spans", _pairs("start", "end"))])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def item_windows(text: bytes, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    words = words_of(text)
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Items:
    """The automaton of some benchmark items, and the items' words to extend matches along."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        grouped: dict[tuple[bytes, ...], list[str]] = {}
        for name, text in items:
            grouped.setdefault(tuple(words_of(text)), []).append(name)
        self.window, self.items = window, [(list(words), names) for words, names in grouped.items() if words]
        block = max(1, window // 2)
        self._automaton = PhraseAutomaton(
            (tuple(words[at : at + block]), (number, at)) if len(words) >= window else (tuple(words), (number, 0))
            for number, (words, _) in enumerate(self.items)
            for at in (range(0, len(words) - block + 1, block) if len(words) >= window else (0,))
        )

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(merged word ranges of occurring windows, names of the items they are of)."""
        places, names = [], set()
        done: dict[tuple[int, int], int] = {}  # (item, document word less item word) -> end of the last match
        for first, end, payloads in self._automaton.find(words):
            for number, at in payloads:
                item, of = self.items[number]
                n = len(item)
                if n >= self.window:
                    key = number, first - at
                    if done.get(key, -1) >= end:
                        continue
                    begin, stop = first, end
                    back, ahead = at, at + end - first
                    while begin and back and words[begin - 1] == item[back - 1]:
                        begin, back = begin - 1, back - 1
                    while stop < len(words) and ahead < n and words[stop] == item[ahead]:
                        stop, ahead = stop + 1, ahead + 1
                    done[key] = stop
                    if stop - begin < self.window:
                        continue
                    places.append((begin, stop))
                else:
                    places.append((first, end))
                names.update(of)
        return merge(places), names

    def occurs(self, words: list[bytes]) -> bool:
        return bool(self.find(words)[0])


def _parts(benchmark: DataFrame, part_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in parts of about ``part_bytes``. It is the bounded side, but its bytes are counted before any are collected."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / part_bytes))
    for part in range(parts):
        mine = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield [(r[0], r[1].encode()) for r in mine.collect()]


def _scan(docs: DataFrame, items: list[tuple[str, bytes]], window: int, every: bool, carried: list[str]) -> DataFrame:
    """SCAN_SCHEMA and the named long columns for ``docs(doc_id, text)``; only documents with hits unless ``every``."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def make():
        automaton = Items(shared.value, window)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, n_words, hits, ids, spans = [], [], [], [], []
            for row, text in enumerate(texts(batch.column(1))):
                words = words_of(text)
                places, names = automaton.find(words)
                if not (every or places):
                    continue
                rows.append(row)
                n_words.append(len(words))
                hits.append([{"first": f, "end": e} for f, e in places])
                ids.append(sorted(names))
                at = word_offsets(text.decode()) if places else []
                spans.append([{"start": at[f][0], "end": at[e - 1][1]} for f, e in places])
            index = pa.array(rows, pa.int64())
            made = [batch.column(0).take(index), *(pa.array(c, k) for c, k in zip((n_words, hits, ids, spans), _ARROW.types[1:]))]
            return pa.RecordBatch.from_arrays([*made, *(batch.column(2 + i).take(index) for i in range(len(carried)))], names=[*_ARROW.names, *carried])

        return step

    return map_batches(docs.select("doc_id", "text", *carried), make, SCAN_SCHEMA + "".join(f", {c} long" for c in carried))


#: What tells rows apart when hits of several parts of the benchmark come together; rows that agree in it have the same hits.
_KEY = ["text_hash", "text_length", "id_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.length(text), F.lit(-1)).cast("long").alias("text_length"), F.xxhash64(F.col("doc_id").cast("long")).alias("id_hash"))


def _together(rows: DataFrame) -> DataFrame:
    """SCAN_SCHEMA from rows (doc_id, n_words, found), where found lists the (hits, item_ids, spans) of the parts of the benchmark."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for r in batch.to_pylist():
                word = [(h["first"], h["end"], s["start"], s["end"]) for f in r["found"] for h, s in zip(f["hits"], f["spans"])]
                hits = merge([w[:2] for w in word])
                mine = [[w for w in word if first <= w[0] and w[1] <= end] for first, end in hits]
                spans = [{"start": min(w[2] for w in m), "end": max(w[3] for w in m)} for m in mine]
                out.append({"doc_id": r["doc_id"], "n_words": r["n_words"], "hits": [{"first": f, "end": e} for f, e in hits], "item_ids": sorted({i for f in r["found"] for i in f["item_ids"]}), "spans": spans})
            return pa.RecordBatch.from_pylist(out, schema=_ARROW)

        return step

    return map_batches(rows, make, SCAN_SCHEMA)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, hits (word ranges), item_ids (as strings) and spans
    (code point ranges of the hits in the original text), against ``benchmark(item_id, text)``."""
    parts = _parts(benchmark, part_bytes)
    keyed, first, more = _keyed(docs), next(parts), None
    for items in parts:
        part = materialise(_scan(keyed, items, window, False, _KEY))
        more = part if more is None else more.unionByName(part)
    if more is None:
        return _scan(keyed, first, window, True, [])
    one = F.struct("hits", "item_ids", "spans")
    hit = more.distinct().groupBy(*_KEY).agg(F.collect_list(one).alias("more"))  # at most one row a part
    every = _scan(keyed, first, window, True, _KEY).join(hit, _KEY, "left")
    return _together(every.select("doc_id", "n_words", F.concat(F.array(one), F.coalesce("more", F.array())).alias("found")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns; one pass and no shuffle for a benchmark of one part."""
    parts = _parts(benchmark, part_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(next(parts))
    at = docs.columns.index("text")

    def make():
        automaton = Items(shared.value, window)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([not automaton.occurs(words_of(t)) for t in texts(batch.column(at))], pa.bool_()))

        return step

    kept = map_batches(docs, make, docs.schema)
    keyed = _keyed(docs)
    for items in parts:
        hit = materialise(_scan(keyed, items, window, False, _KEY).select(*_KEY).distinct())
        text, doc_id = kept["text"].cast("string"), kept["doc_id"].cast("long")
        same = (F.xxhash64(text) == hit["text_hash"]) & (F.coalesce(F.length(text), F.lit(-1)) == hit["text_length"]) & (F.xxhash64(doc_id) == hit["id_hash"])
        kept = kept.join(hit, same, "left_anti")
    return kept


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's output."""
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["end"] - h["first"]).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))).alias("spans"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return digest(find_contamination(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text")))


def brute_force(doc: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """n_words, n_hit, n_items, items_sha256, contaminated by comparing every window at every place."""
    words = words_of((doc or "").encode())
    hit, names = set(), set()
    for item, text in items:
        for w in item_windows((text or "").encode(), window):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    names.add(str(item))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


ORACLE = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
place AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc WHERE len(w) > 0),
occ AS (
  SELECT p.doc_id, p.i, l.n, win.item_id
  FROM place p JOIN (SELECT DISTINCT n FROM win) l ON p.i + l.n - 1 <= len(p.w)
  JOIN win ON win.n = l.n AND win.s = list_aggregate(p.w[p.i:p.i + l.n - 1], 'string_agg', ' ')),
word AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM occ),
hit AS (
  SELECT doc_id, count(*) AS n_hit FROM word GROUP BY doc_id),
place_of AS (
  SELECT doc_id, i, sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY i) + sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, length(x) AS n
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x,
          unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')[1:len(w)]) AS gap
        FROM doc JOIN documents USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM hit))),
span AS (
  SELECT doc_id, min(upto - n) AS s, max(upto) AS e
  FROM (SELECT word.doc_id, upto, n, j - row_number() OVER (PARTITION BY word.doc_id ORDER BY j) AS island FROM word JOIN place_of ON place_of.doc_id = word.doc_id AND place_of.i = word.j)
  GROUP BY doc_id, island),
spans AS (
  SELECT doc_id, string_agg(CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY s) AS spans FROM span GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
