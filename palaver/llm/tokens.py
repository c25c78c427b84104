"""Operator 4: token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Every node carries a failure link and the number of pieces that are popped when it
is followed, both computed once, so one pass over a word's bytes gives the length of its greedy longest-match
segmentation; no piece is ever cut out.

Words are runs of non-white-space (``[^\\x20\\x09-\\x0D]+``), each read with one space before it, as the vocabularies
of byte-level tokenizers have it. A word that the vocabulary cannot cover counts as one unknown token.

Defined results: null and empty texts have 0 words and 0 tokens; very long texts are read whole, in time linear in their length; rows that repeat a doc_id or a whole row each get their own result;
null doc_ids are carried through; an empty table gives no row. Only id and text are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table, texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary goes to every executor; a larger file is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Word lengths that a worker keeps; then it starts anew.
MEMO_WORDS = 300_000


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a ranks file: a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return [base64.b64decode(line.split()[0]) for line in data.splitlines() if line.strip()]


class LongestMatch:
    """Greedy longest-match lengths. ``next``: node -> byte -> node; ``fail``: node -> node, -1 where the match is stuck;
    ``pops``: pieces counted when the failure link is followed."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                to = self.next[node].get(byte)
                if to is None:
                    to = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = to
            ends[node] = ends[node] or node > 0
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for parent in level:
                for byte, node in self.next[parent].items():
                    below.append(node)
                    if ends[node]:
                        self.fail[node], self.pops[node] = 0, 1
                        continue
                    at, popped = self.fail[parent], self.pops[parent]
                    while at >= 0 and byte not in self.next[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.pops[node] = self.next[at][byte], popped
            level = below

    def length(self, word: bytes) -> int:
        """Pieces in the greedy segmentation of ``word``, or -1 if a part of it has no piece."""
        step, fail, pops, node, count = self.next, self.fail, self.pops, 0, 0
        for byte in word:
            to = step[node].get(byte)
            while to is None:
                count += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
                to = step[node].get(byte)
            node = to
        while node:
            count += pops[node]
            node = fail[node]
            if node < 0:
                return -1
        return count


_BUILT: list[LongestMatch] = []


def _automaton(pieces: list[bytes]) -> LongestMatch:
    """One automaton a Python worker, which Spark keeps over tasks."""
    if not _BUILT or _BUILT[0].pieces != pieces:
        _BUILT[:] = [LongestMatch(pieces)]
    return _BUILT[0]


def count_tokens(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for each row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def make():
        automaton = _automaton(shared.value)

        class Memo(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= MEMO_WORDS:
                    self.clear()
                n = self[word] = automaton.length(b" " + word)
                return n

        memo = Memo()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_tokens, n_unknown = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, text in enumerate(texts(batch.column(1))):
                lengths = [memo[w] for w in text.split()]
                unknown = lengths.count(-1)
                n_words[row], n_tokens[row], n_unknown[row] = len(lengths), sum(lengths) + 2 * unknown, unknown
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": n_words, "n_tokens": n_tokens, "n_unknown": n_unknown})

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_pieces(vocabulary))


def brute_force(word: bytes, pieces: set[bytes]) -> list[bytes] | None:
    """Greedy longest match by cutting pieces out."""
    out, at = [], 0
    while at < len(word):
        n = next((n for n in range(len(word) - at, 0, -1) if word[at : at + n] in pieces), 0)
        if not n:
            return None
        out.append(word[at : at + n])
        at += n
    return out
