"""Operator 3: licence scan. Aho-Corasick finds identifier tags and notice phrases; a shunting-yard parser evaluates
the and/or/with expressions behind the tags.

The expression of a tag is the longest run of tokens behind it, on its line, that is an expression, so prose behind it does no harm. An operand is
a known licence or looks like an identifier (a digit, a hyphen, or capitals only); ``/`` reads as ``or``.

Score: how freely the text may be used, from 0 (no grant found, or none that permits use) to 1 (permissive). Each
notice phrase and each expression is one statement, but not a phrase inside a longer one (``general public license`` in ``lesser general public
license``); ``or`` takes the better operand, ``and`` the worse one, ``with`` lifts its operand by 0.3; the document has its worst statement's score.

Defined results: null and empty texts have no words, no labels and score 0; very long texts are read whole, in time linear in their length; a tag
with no expression behind it gives no label and is counted in ``n_bad_tags``; equal or overlapping base phrases all count; ``cc by`` notices have to be
written in capitals; rows that repeat a doc_id each get their own result; null doc_ids are carried through; an empty table gives no row. Only id and text
are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table, texts
from .phrases import PhraseAutomaton, word_offsets, words_of

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons zero": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creativecommons org licenses by": "cc-by",
    "creativecommons org licenses by sa": "cc-by-sa",
    "creativecommons org licenses by nc": "cc-by-nc",
    "creativecommons org licenses by nd": "cc-by-nd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier", "license expression")
OPENNESS = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "bsl": 1.0, "cc0": 1.0, "unlicense": 1.0, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.4, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "proprietary": 0.0}
#: Labels whose short notices are words of everyday prose unless they stand in capitals.
CAPITALS = ("cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd")
UNKNOWN = 0.1
EXCEPTION_LIFT = 0.3

_TOKEN = re.compile(r"[ \t]*(?:([()/])|([A-Za-z0-9][A-Za-z0-9.+-]*))")
_LEAD = re.compile(r"[ \t:=\"']*")
_BINDS = {"or": 1, "and": 2, "with": 3}
_FAMILIES = ("cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "cc0", "lgpl", "agpl", "gpl", "apache", "bsd", "mpl", "epl", "mit", "isc", "zlib", "bsl", "unlicense")


def label_of(identifier: str) -> str:
    """The label of an identifier such as ``Apache-2.0`` or ``GPL-2.0-or-later``: its family, else itself."""
    name = identifier.lower().rstrip("+")
    return next((f for f in _FAMILIES if name == f or name.startswith(f + "-")), name)


def _is_operand(word: str) -> bool:
    if word.lower() == "spdx-license-identifier":  # the next tag
        return False
    return label_of(word.rstrip(".")) in OPENNESS or any(c.isdigit() or c == "-" for c in word) or (len(word) > 1 and word.isupper())


def tokens_at(text: str, at: int) -> list[str]:
    """The longest expression in ``text`` from ``at`` on, as tokens; empty if there is none."""
    tokens: list[str] = []
    depth = whole = 0
    while m := _TOKEN.match(text, at):
        at = m.end()
        token = "or" if m[1] == "/" else m[1] or (m[2].lower() if m[2].lower() in _BINDS else m[2].rstrip("."))
        before = tokens[-1] if tokens else "or"
        operand_next = before in _BINDS or before == "("
        if token == "(":
            fits = operand_next and before != "with"
            depth += 1
        elif token == ")":
            fits = not operand_next and depth > 0
            depth -= 1
        elif token == "with":  # an exception belongs to one licence, and a licence has one
            fits = not operand_next and before != ")" and tokens[-2:-1] != ["with"]
        elif token in _BINDS:
            fits = not operand_next
        else:
            fits = operand_next and _is_operand(token)
        if not fits:
            break
        tokens.append(token)
        if not depth and (token == ")" or token not in _BINDS and token != "("):
            whole = len(tokens)
    return tokens[:whole]


def to_postfix(tokens: list[str]) -> list[str]:
    """Reverse Polish form of the tokens of an expression by the shunting-yard rule."""
    out: list[str] = []
    waiting: list[str] = []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + waiting[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels of all named licences and the score; the right side of ``with`` is an exception, not a licence."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in _BINDS:
            (right_labels, right), (left_labels, left) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left_labels, min(1.0, left + EXCEPTION_LIFT)))
            else:
                stack.append((left_labels | right_labels, (max if token == "or" else min)(left, right)))
        else:
            label = label_of(token)
            stack.append(({label}, OPENNESS.get(label, UNKNOWN)))
    return stack.pop()


def _automaton() -> PhraseAutomaton:
    kinds = [(p, ("base", label)) for p, label in BASE.items()] + [(p, ("notice", label)) for p, label in NOTICES.items()] + [(p, ("tag", "")) for p in TAGS]
    return PhraseAutomaton((tuple(words_of(p.encode())), payload) for p, payload in kinds)


def scan_text(text: bytes, automaton: PhraseAutomaton) -> dict:
    words = words_of(text)
    base, labels, scores, tags, bad = [], set(), [], [], 0
    found = [(first, end, kind, label) for first, end, payloads in automaton.find(words) for kind, label in payloads]
    decoded, at = "", []
    if any(kind == "tag" or label in CAPITALS for _, _, kind, label in found):
        decoded = text.decode()
        at = word_offsets(decoded)
    found = [f for f in found if not (f[3] in CAPITALS and words[f[0]] == b"cc" and not decoded[at[f[0]][0] : at[f[0] + 1][1]].isupper())]
    reach = -1
    for first, end, kind, label in sorted(found, key=lambda f: (f[0], -f[1])):
        inside = end <= reach  # a phrase that starts no later goes at least as far
        if kind == "base":
            base.append((first, label))
        if kind == "tag":
            tokens = tokens_at(decoded, _LEAD.match(decoded, at[end - 1][1]).end())
            if not tokens:
                bad += 1
                continue
            found_labels, score = evaluate(to_postfix(tokens))
            labels |= found_labels
            scores.append(score)
            tags.append({"start": at[first][0], "expression": " ".join(tokens), "score": score})
            continue
        if kind == "base" or not inside:
            labels.add(label)
        if not inside:
            scores.append(OPENNESS[label])
            reach = end
    return {"n_words": len(words), "base": [{"word": f, "label": x} for f, x in sorted(base)], "labels": sorted(labels), "tags": tags, "n_bad_tags": bad, "score": min(scores, default=0.0)}


SCHEMA = "doc_id long, n_words long, base array<struct<word:long,label:string>>, labels array<string>, tags array<struct<start:long,expression:string,score:double>>, n_bad_tags long, score double"


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: base places, all labels, identifier tags (code point offsets), score."""

    def make():
        automaton = _automaton()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scan_text(t, automaton) for t in texts(batch.column(1))]
            place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
            tag = pa.list_(pa.struct([("start", pa.int64()), ("expression", pa.string()), ("score", pa.float64())]))
            kinds = {"n_words": pa.int64(), "base": place, "labels": pa.list_(pa.string()), "tags": tag, "n_bad_tags": pa.int64(), "score": pa.float64()}
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()})

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.word")).alias("first_word"),
        F.array_max(F.col("base.word")).alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.col("labels")).alias("labels"),
        "score",
        F.size("tags").cast("long").alias("n_tags"),
        "n_bad_tags",
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_licences(read_table(spark, sf_dir, "documents", "doc_id", "text")))
