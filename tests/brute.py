"""Whole results of the queries that have no SQL twin, computed in plain Python from the tables: name -> function(spark, sf_dir) -> sorted rows."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from palaver.operators import alignment, networks, repairs
from palaver.queries.base import by_line, tagged, words
from palaver.queries.live import LABELS, make_session
from palaver.streaming import tagger


def _utterances(spark, sf, *columns, where="true"):
    out: dict = {}
    for r in words(spark, sf).filter(where).select("conv_id", "utt", "idx", *columns).orderBy("conv_id", "utt", "idx").collect():
        out.setdefault((r["conv_id"], r["utt"]), []).append(r)
    return out


def _both_sides(spark, sf):
    for key, rows in _utterances(spark, sf, "word").items():
        letter = [chr(len(r["word"]) % 26 + 97) for r in rows]
        yield key, letter, [("z" if r["idx"] % 5 == 1 else t) for r, t in zip(rows, letter) if r["idx"] % 7 != 3]


def _costs(ref, hyp):
    """Cheapest edit costs of all prefixes, a cell at a time."""
    table = {(i, 0): i for i in range(len(ref) + 1)} | {(0, j): j for j in range(len(hyp) + 1)}
    for i, x in enumerate(ref, 1):
        for j, y in enumerate(hyp, 1):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (0 if x == y else 2))
    return table


def _walks(ref, hyp, most):
    """The first walks back through the table, substitutions before deletions before insertions."""
    table = _costs(ref, hyp)

    def back(i, j):
        if not i and not j:
            yield ()
            return
        if i and j and table[i, j] == table[i - 1, j - 1] + (0 if ref[i - 1] == hyp[j - 1] else 2):
            yield from (((i - 1, j - 1, "ID" if ref[i - 1] == hyp[j - 1] else "S_ARB"), *w) for w in back(i - 1, j - 1))
        if i and table[i, j] == table[i - 1, j] + 1:
            yield from (((i - 1, max(0, j - 1), "DEL"), *w) for w in back(i - 1, j))
        if j and table[i, j] == table[i, j - 1] + 1:
            yield from (((max(0, i - 1), j - 1, "INS"), *w) for w in back(i, j - 1))

    import sys

    sys.setrecursionlimit(20_000)
    return [w[::-1] for w in itertools.islice(back(len(ref), len(hyp)), most)], table[len(ref), len(hyp)]


def word_alignments(spark, sf):
    out = []
    for key, ref, hyp in _both_sides(spark, sf):
        (walk,), cost = _walks(ref, hyp, 1)
        out.append((*key, " ".join(f"{i}>{j}:{op}" for i, j, op in walk), cost))
    return out


def ranked_alignments(spark, sf):
    return [(*key, [" ".join(op for _, _, op in w) for w in _walks(ref, hyp, 5)[0]]) for key, ref, hyp in _both_sides(spark, sf)]


def carried_labels(spark, sf):
    out = []
    for key, ref, hyp in _both_sides(spark, sf):
        carried = ["-"] * len(hyp)
        for i, j, op in _walks(ref, hyp, 1)[0][0]:
            if op in ("ID", "S_ARB"):
                carried[j] = str(i)
        out.append((*key, ",".join(carried)))
    return out


def common_runs(spark, sf):
    import difflib

    out = []
    for key, ref, hyp in _both_sides(spark, sf):
        found, parts = [], [(0, len(ref), 0, len(hyp))]
        matcher = difflib.SequenceMatcher(None, ref, hyp, autojunk=False)
        while parts:
            a, b, c, d = parts.pop()
            m = matcher.find_longest_match(a, b, c, d)
            if m.size >= 2:
                found.append((m.a, m.b, m.size))
                parts += [(a, m.a, c, m.b), (m.a + m.size, b, m.b + m.size, d)]
        out.append((*key, [f"{a}:{b}:{n}" for a, b, n in sorted(found)]))
    return out


def repair_classes(spark, sf):
    """All paths of the edit graph of every repair, the cheapest first."""
    pos = lambda w: "NN" if len(w) > 3 else "IN"

    def price(x, y):
        cases = [(x == y, 0, "REP"), (x.endswith("-") and x[:-1] in y, 1, "REP_complete"), (y.endswith("-") and y[:-1] in x, 1, "REP_partial"), (pos(x) == pos(y), 2, "SUB_POS"), (pos(x)[0] == pos(y)[0], 5, "SUB_POS_CLASS"), (True, 7, "S_ARB")]
        return min((c, k, name) for k, (holds, c, name) in enumerate(cases) if holds)

    def cheapest(a, b):
        """(cost, ranks of the steps from the end, names)"""
        if not a and not b:
            return 0, (), ()
        options = []
        if a and b:
            c, r, n = cheapest(a[:-1], b[:-1])
            p, _, name = price(a[-1], b[-1])
            options.append((c + p, 0, r, (*n, name)))
        if a:
            c, r, n = cheapest(a[:-1], b)
            options.append((c + 4, 1, r, (*n, "DEL")))
        if b:
            c, r, n = cheapest(a, b[:-1])
            options.append((c + 4, 2, r, (*n, "INS")))
        c, rank, r, n = min(options, key=lambda o: o[:2])
        return c, (rank, *r), n

    table = repairs.repair_table(tagged(spark, sf), "gold").select("conv_id", "utt", "id", "reparandum", "repair").collect()
    out = []
    for r in table:
        cost, _, names = cheapest(r["reparandum"].split(" "), r["repair"].split(" "))
        out.append((r["conv_id"], r["utt"], r["id"], " ".join(names), cost))
    return out


def network_emissions(spark, sf):
    """Both networks written out gate by gate."""
    elman, lstm = networks.random_elman(3, 8, 5, seed=3), networks.random_lstm(3, 8, 5, seed=4)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def softmax(v):
        e = np.exp(v)
        return e / e.sum()

    out = []
    for key, rows in _utterances(spark, sf, "word").items():
        h, hl, c = np.zeros(8), np.zeros(8), np.zeros(8)
        mass = [0.0, 0.0]
        for r in rows:
            x = np.array([len(r["word"]) / 10, r["idx"] / 10, 1.0])
            h = sig(x @ elman.wx + h @ elman.wh + elman.bh)
            mass[0] += softmax(h @ elman.w + elman.b).sum()
            i = sig(x @ lstm.wx["i"] + hl @ lstm.wh["i"] + c @ lstm.wc["i"] + lstm.b["i"])
            f = sig(x @ lstm.wx["f"] + hl @ lstm.wh["f"] + c @ lstm.wc["f"] + lstm.b["f"])
            c = f * c + i * np.tanh(x @ lstm.wx["c"] + hl @ lstm.wh["c"] + lstm.b["c"])
            hl = sig(x @ lstm.wx["o"] + hl @ lstm.wh["o"] + c @ lstm.wc["o"] + lstm.b["o"]) * np.tanh(c)
            mass[1] += softmax(hl @ lstm.w + lstm.wb)[0]
        first = [softmax(h @ elman.w + elman.b)[0], softmax(hl @ lstm.w + lstm.wb)[0]]
        out += [(*key, net, len(rows), round(float(first[n]), 6)) for n, net in enumerate(("elman", "lstm"))]
    return out


def timing_classifier(spark, sf):
    """Weighted logistic regression on scaled times by Newton steps."""
    lines: dict = {}
    for r in words(spark, sf).select("conv_id", "speaker", "pos", "idx", "start_ms").orderBy("conv_id", "speaker", "pos").collect():
        lines.setdefault((r["conv_id"], r["speaker"]), []).append((r["start_ms"], r["idx"]))
    x, y = [], []
    for line in lines.values():
        delta = [0.0] + [b[0] - a[0] for a, b in zip(line, line[1:])]
        for n, (_, idx) in enumerate(line):
            x.append([delta[n], delta[n - 1] if n > 0 else 0.0, delta[n - 2] if n > 1 else 0.0])
            y.append(int(idx == 0))
    x, y = np.array(x), np.array(y)
    x = np.c_[(x - x.mean(axis=0)) / x.std(axis=0, ddof=1), np.ones(len(x))]
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-12 * np.eye(4), x.T @ (weight * (y - p)))
    predicted = (x @ beta > 0).astype(int)
    return [(int(a), int(b), int(((y == a) & (predicted == b)).sum())) for a in (0, 1) for b in (0, 1) if ((y == a) & (predicted == b)).any()]


class _Whole:
    """A session that keeps all words, columns and labels of a part and works everything out anew."""

    def __init__(self):
        self.session, self.part = make_session(), 0
        self.clear()

    def clear(self):
        self.words, self.columns, self.settled, self.tags = [], [], [], []
        self.start, self.fixed = 0, 0  # columns from here on are open; of them so many cannot be revoked

    def path(self):
        ends = [(c[0], -j) for j, c in enumerate(self.columns[-1]) if c]
        at, out = -max(ends)[1], []
        for column in self.columns[: self.start - 1 if self.start else None : -1]:
            out.append(at)
            at = column[at][1]
        return out[::-1]

    def column(self):
        scores = self.session.emit(self.words)
        lattice, before = self.session.lattice, self.columns[-1] if self.columns else None
        out = []
        for j, label in enumerate(LABELS):
            best = None
            for i, (score, state) in enumerate([(0.0, "s")] if before is None else [(c[0], c[2]) if c else (None, None) for c in before]):
                entered = None if score is None else lattice.state_of("" if state == "s" else state, label)
                w = lattice.weights.get((state, entered)) if entered else None
                if w is not None and (best is None or score + w + scores[j] > best[0]):
                    best = (score + w + scores[j], -1 if before is None else i, entered)
            out.append(best)
        return out

    def apply(self, row):
        if row["control"] == "reset":
            self.clear()
            self.part += 1
        elif row["control"] == "commit" and self.columns:
            path = self.path()
            self.settled += path[:-1]
            self.columns[-1] = [c if j == path[-1] else None for j, c in enumerate(self.columns[-1])]
            self.start, self.fixed = len(self.columns) - 1, 1
        before = list(self.tags)
        for _ in range(row["rollback"]):
            self.words.pop()
            self.columns.pop()
        for w in row["words"]:
            self.words.append(w)
            self.columns.append(self.column())
        path = self.path()
        self.tags = repairs.eval_tags([LABELS[i] for i in self.settled + path], self.words)
        over = len(self.columns) - self.start - tagger.HISTORY
        if over > 0:
            self.settled += path[:over]
            self.start, self.fixed = self.start + over, 0
        first = next((i for i, (a, b) in enumerate(zip(before, self.tags)) if a != b), min(len(before), len(self.tags)))
        return [(self.part, len(self.words), i, self.words[i], self.tags[i], None) for i in range(first, len(self.words))]

    def revocable(self):
        return len(self.columns) - self.start - self.fixed


def tag_updates(spark, sf):
    from palaver.queries.live import _updates

    out, whole, key = [], None, None
    for row in _updates(spark, sf).orderBy("key", "update_no").collect():
        if row["key"] != key:
            key, whole = row["key"], _Whole()
        at = (key, row["update_no"])
        if row["control"] and row["rollback"]:
            out.append((*at, whole.part, len(whole.words), None, None, None, f"{row['rollback']} words to revoke behind a {row['control']}"))
        elif row["rollback"] > whole.revocable():
            out.append((*at, whole.part, len(whole.words), None, None, None, f"{row['rollback']} words to revoke, but only {whole.revocable()} can be"))
        else:
            out += [(*at, *r) for r in whole.apply(row)]
    return out


def tag_updates_final(spark, sf):
    last: dict = {}
    length: dict = {}
    for key, _, part, n, idx, word, tag, fault in tag_updates(spark, sf):
        if fault is None:
            last[key, part, idx] = (word, tag)
            length[key, part] = n
    return [(*k, *v) for k, v in last.items() if k[2] < length[k[:2]]]


def tagged_files(spark, sf):
    """Word by word, without files; an update's words are numbered from 0."""
    out = []
    lines: dict = {}
    for r in by_line(words(spark, sf)).select("conv_id", "pos", "word").orderBy("conv_id", "pos").collect():
        lines.setdefault(r["conv_id"], []).append(r["word"])
    for conv_id, said in lines.items():
        whole = _Whole()
        for n, word in enumerate(said):
            rows = whole.apply({"control": None, "rollback": 0, "words": [word]})
            out += [(conv_id, n, i, w, tag) for i, (_, _, _, w, tag, _) in enumerate(rows)]
    return out


def fluent_sequences(spark, sf):
    """The best taggings by growing plain lists of tags, scored with the model's rows."""
    import plain_source

    from palaver.queries.modelling import _model

    rows = [tuple(r) for r in _model(spark, sf)[0].select("order", "context", "word", "num", "den", "nz").collect()]
    p, known = plain_source.Trigrams(rows).p, {r[2] for r in rows if r[0] == 1}
    log2 = lambda x: math.log2(x) if x > 0 else -math.inf
    out = []
    for key, said in _utterances(spark, sf, "word").items():
        front = [(0.0, [], ["<s>", "<s>"], 0)]
        for i, row in enumerate(said):
            word, grown = row["word"] if row["word"] in known else "<unk>", []
            for score, tags, context, edited in front:
                end = log2(p(context, "</s>")) if i else 0.0
                grown.append((score + end + log2(p(["<s>", "<s>"], word)), [*tags, "s"], ["<s>", word], 0))
                if edited < 2:
                    grown.append((score + math.log2(0.01), [*tags, "e"], context, edited + 1))
                if context[1] != "<s>":
                    grown.append((score + log2(p(context, word)), [*tags, "f"], [context[1], word], 0))
            front, seen = [], {}
            for h in sorted(grown, key=lambda h: -h[0]):
                state = (*h[2], h[3])
                seen[state] = seen.get(state, 0) + 1
                if seen[state] <= 3 and h[0] > -math.inf:
                    front.append(h)
        out += [(*key, rank, "".join(h[1]), round(h[0], 6)) for rank, h in enumerate(front[:3])]
    return out


BRUTE = {f.__name__: f for f in (fluent_sequences, word_alignments, ranked_alignments, carried_labels, common_runs, repair_classes, network_emissions, timing_classifier, tag_updates, tag_updates_final, tagged_files)}
