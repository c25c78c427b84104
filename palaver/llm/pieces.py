"""Operator 13: SentencePiece encoding and decoding with a prefix table.

A piece vocabulary with scores joins, of all neighbouring symbols whose concatenation is a piece, the best-scored first (the leftmost of equals), until none is left. The result has a
property that makes it readable from a table: a sequence of pieces is what joining gives if and only if every piece joins up from its own characters and every two neighbours
are what joining gives for the two alone. So each prefix of a text has one last piece, and it is found from shorter prefixes: of the pieces that end there (one pass of an
Aho-Corasick automaton finds them all) it is the one that is compatible with the last piece of the prefix before it. The table holds one piece a prefix; ids are read off from the end
backwards. Time is linear in the text, whatever its words; nothing is joined but the two pieces of a compatibility test, whose outcome is kept.

A character that no piece is made of is a symbol of its own and is written as the pieces of its UTF-8 bytes. Blanks are read as U+2581, and one stands before a text that is not empty. Nothing is joined across a
border that no piece reaches over: around a character that is in no longer piece and, if no piece holds U+2581 behind another character, before U+2581. So a text falls into words whose ids are kept.

``decode`` is the inverse: surfaces end to end, U+2581 as blanks, one leading blank taken off, runs of byte pieces read as UTF-8 with U+FFFD for each byte that is no part of a character,
control pieces left out, unknown ones by their surface.

Defined results: null and empty texts have the begin and end ids only and decode to the empty text; very long texts are read whole, in linear time; rows that repeat a doc_id or a whole row each get
their own result; null doc_ids are carried through; an empty table gives no row. Only id and text are read, so further columns of any name do not matter. A model that normalises, trims or drops characters, has
pieces of the user or no byte pieces is refused.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import pairwise
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table

MODEL = "piece_bpe_32k.model"
#: The vocabulary goes to every executor; a larger file is refused.
MAX_MODEL_BYTES = 64 << 20
#: Words whose ids, and pairs of pieces whose test, a worker keeps; then it starts anew. Longer words than KEPT_LETTERS are not kept.
MEMO_WORDS, MEMO_PAIRS, KEPT_LETTERS = 400_000, 1_000_000, 64

MARK = "▁"
_LOST = "�".encode()
# fixed values: kinds of pieces in a model file
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id with their scores and kinds; the ids that begin and end a text."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    begin: int
    end: int
    unknown_surface: str


def read_vocabulary(path: str) -> Vocabulary:
    """A model file of the sentencepiece library with merges by score, byte pieces and no normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    model = schema.ModelProto.FromString(data)
    trainer, normalizer = model.trainer_spec, model.normalizer_spec
    if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
        raise ValueError(f"{path} has no merges by score, no byte pieces, or blanks behind words")
    if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.add_dummy_prefix or not normalizer.escape_whitespaces:
        raise ValueError(f"{path} normalises texts")
    kinds = tuple(p.type for p in model.pieces)
    if not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE} or kinds.count(BYTE) != 256:
        raise ValueError(f"{path} has pieces of the user, unused pieces, or not every byte")
    return Vocabulary(tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), kinds, trainer.bos_id, trainer.eos_id, trainer.unk_surface)


def join_up(symbols: list[str], scores: dict[str, float], border: int = 0) -> list[str] | None:
    """Symbols after all joins. With a ``border`` (so many characters from the left), None as soon as a join crosses it."""
    symbols = list(symbols)
    while True:
        best, at = None, -1
        for k, (a, b) in enumerate(pairwise(symbols)):
            score = scores.get(a + b)
            if score is not None and (best is None or score > best):
                best, at = score, k
        if best is None:
            return symbols
        if border and sum(map(len, symbols[: at + 1])) == border:
            return None
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


#: Of a piece that may be the last of a prefix: its size, itself, its id (-1: a character that no piece stands for), and for ids that may follow whether they are compatible.
Entry = tuple[int, str, int, dict[int, bool]]


class PrefixTable:
    """Encodes words by the last piece of each prefix; built once a worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        normal = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.kinds[i] == NORMAL}
        self.scores = {p: vocabulary.scores[i] for p, i in normal.items()}
        self.bytes_ids = [0] * 256
        for i, p in enumerate(vocabulary.pieces):
            if vocabulary.kinds[i] == BYTE:
                self.bytes_ids[int(p[1:-1], 16)] = i
        self.automaton = ahocorasick.Automaton()
        for piece, i in normal.items():
            if join_up(list(piece), self.scores) == [piece]:
                self.automaton.add_word(piece, (len(piece), piece, i, {}))
        self.automaton.make_automaton()
        self.tested: list[dict[int, bool]] = []  # one item a pair that is kept
        self.characters: dict[str, Entry] = {}
        longer = [p for p in normal if len(p) > 1]
        joined = re.escape("".join(sorted(set("".join(longer)) - {MARK}))) or MARK
        in_front = all(MARK not in p.lstrip(MARK) for p in longer)
        self.words = re.compile(f"{MARK}+[{joined}]*|[{joined}]+|[^{joined}{MARK}]" if in_front else f"[{joined}{MARK}]+|[^{joined}{MARK}]").findall
        self.known: dict[str, bytes] = {}
        surface = {NORMAL: lambda p: p.replace(MARK, " ").encode(), BYTE: lambda p: bytes([int(p[1:-1], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: vocabulary.unknown_surface.encode()}
        self.surfaces = [surface[k](p) for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]
        self.controls = {i for i, k in enumerate(vocabulary.kinds) if k == CONTROL}
        self.marked = [p.startswith(MARK) and k == NORMAL for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]

    def _fits(self, before: Entry, found: Entry) -> bool:
        if len(self.tested) >= MEMO_PAIRS:
            for followers in self.tested:
                followers.clear()
            self.tested.clear()
        self.tested.append(before[3])
        fits = before[3][found[2]] = join_up([*before[1], *found[1]], self.scores, before[0]) is not None
        return fits

    def _itself(self, character: str) -> Entry:
        if len(self.characters) >= MEMO_WORDS:
            self.characters.clear()
        return self.characters.setdefault(character, (1, character, -1, {}))

    def word_ids(self, word: str) -> list[int]:
        """Ids of a text of marks and characters, from its table of last pieces."""
        # of the prefix that ends behind each character: its last piece
        last: list[Entry | None] = [None] * len(word)
        for end, found in self.automaton.iter(word):
            if last[end] is None:
                start = end - found[0]
                if start < 0:
                    last[end] = found
                    continue
                before = last[start]
                if before is None:
                    before = last[start] = self._itself(word[start])
                fits = before[3].get(found[2])
                if fits or (fits is None and self._fits(before, found)):
                    last[end] = found
        out, at = [], len(word) - 1
        while at >= 0:
            size, piece, i, _ = last[at] or self._itself(word[at])
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.bytes_ids[b] for b in reversed(piece.encode()))
            at -= size
        out.reverse()
        return out

    def _word(self, word: str) -> bytes:
        ids = self.word_ids(word)
        ids = pack(f"<{len(ids)}I", *ids)
        if len(word) <= KEPT_LETTERS:
            if len(self.known) >= MEMO_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text between the begin and end ids."""
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.vocabulary.begin, self.vocabulary.end))
        known, word = self.known, self._word
        marked = (MARK + text.replace(" ", MARK)) if text else ""
        return np.frombuffer(b"".join([begin, *(known.get(w) or word(w) for w in self.words(marked)), end]), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text that ids stand for."""
        lead, tail = 0, len(ids)
        while lead < tail and ids[lead] in self.controls:
            lead += 1
        while tail > lead and ids[tail - 1] in self.controls:
            tail -= 1
        ids = ids[lead:tail]
        surfaces = list(map(self.surfaces.__getitem__, ids))
        if ids and self.marked[ids[0]]:
            surfaces[0] = surfaces[0][1:]
        out = b"".join(surfaces)
        try:
            out.decode()
        except UnicodeDecodeError:
            return self._mended(ids, surfaces)
        return out if self.controls.isdisjoint(ids) else self._mended(ids, surfaces)  # a control piece ends a run of bytes

    def _mended(self, ids: list[int], surfaces: list[bytes]) -> bytes:
        """Surfaces end to end; in each run of byte pieces, U+FFFD for every byte that begins no character."""
        out, run = [], b""
        for i, surface in zip([*ids, None], [*surfaces, b""], strict=True):
            if i is not None and self.vocabulary.kinds[i] == BYTE:
                run += surface
                continue
            while run:
                size = next((n for n in (1, 2, 3, 4) if n <= len(run) and _is_character(run[:n])), 0)
                out.append(run[:size] or _LOST)
                run = run[max(1, size) :]
            out.append(surface)
        return b"".join(out)


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


_BUILT: list[PrefixTable] = []


def _table(vocabulary: Vocabulary) -> PrefixTable:
    """One table a Python worker, which Spark keeps over tasks."""
    if not _BUILT or _BUILT[0].vocabulary != vocabulary:
        _BUILT[:] = [PrefixTable(vocabulary)]
    return _BUILT[0]


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ids (array of int) of each row of ``docs(doc_id, text)``."""
    return _per_text(docs, vocabulary, "ids array<int>", lambda table, text: (table.encode(text).astype(np.int32),))


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of each row of ``rows(doc_id, ids)``; null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        table = _table(shared.value)
        return lambda batch: pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array([table.decode(ids.as_py() or []).decode() for ids in batch.column(1)], pa.string())})

    return map_batches(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), make, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encode`` and ``decode`` give for each text, without writing it out."""

    def digest(table: PrefixTable, text: str) -> tuple:
        ids = table.encode(text)
        return ids.size, hashlib.sha256(ids).hexdigest(), hashlib.sha256(table.decode(ids.tolist())).hexdigest()

    return _per_text(docs, vocabulary, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _per_text(docs: DataFrame, vocabulary: Vocabulary, columns: str, run) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [c.split()[0] for c in columns.split(",")]

    def make():
        table = _table(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = zip(*(run(table, text.as_py() or "") for text in batch.column(1)), strict=True)
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {n: pa.array(v) for n, v in zip(names, values, strict=True)})

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, f"doc_id long, {columns}")


def op13_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """``model`` is the path of a model file; by default the public vocabulary."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    return digests(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_vocabulary(model))
