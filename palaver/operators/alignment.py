"""Edit distances and alignments of token arrays. Arrow batches of whole rows; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decoding import sliced


def token_distance(a: list, b: list) -> int:
    """Levenshtein distance of two token lists, one row of the table at a time."""
    if not a or not b:
        return len(a) + len(b)
    # Myers: a column of the table is kept as its steps up and down, a bit a token of ``a``
    masks: dict = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = every, 0, len(a)
    for t in b:
        equal = masks.get(t, 0)
        flat = (((equal & up) + up) ^ up) | equal | down
        right, left = down | every & ~(flat | up), up & flat
        distance += bool(right & top) - bool(left & top)
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(flat | right)) & every, right & flat & every
    return distance


def error_rate(reference: list, hypothesis: list) -> float:
    """Percent of the reference's length; 100 for an empty reference with words against it, else 0."""
    if not reference:
        return 100.0 if hypothesis else 0.0
    return 100.0 * token_distance(reference, hypothesis) / len(reference)


class Rule(NamedTuple):
    """A substitution: its name, its cost, and where it applies, as a matrix over the tokens of both sides."""

    name: str
    cost: int
    applies: Callable[[list, list], np.ndarray]


class Costs(NamedTuple):
    indel: int
    rules: tuple[Rule, ...]


def _equal(of: Callable) -> Callable[[list, list], np.ndarray]:
    """Where both sides agree in a property of their tokens."""

    def matrix(source: list, goal: list) -> np.ndarray:
        ids: dict = {}
        x, y = (np.array([ids.setdefault(of(t), len(ids)) for t in side], np.int64) for side in (source, goal))
        return x[:, None] == y[None, :]

    return matrix


def _fragment_in(broken: int) -> Callable[[list, list], np.ndarray]:
    """Where the word of side ``broken`` (0 or 1) is a fragment (it ends with a hyphen) of the other side's word."""

    def matrix(*sides: list) -> np.ndarray:
        out = np.zeros((len(sides[0]), len(sides[1])), bool)
        for i, fragment in enumerate(sides[broken]):
            if fragment[0].endswith("-"):
                out[(i, slice(None)) if broken == 0 else (slice(None), i)] = [fragment[0][:-1] in t[0] for t in sides[1 - broken]]
        return out

    return matrix


def _always(source: list, goal: list) -> np.ndarray:
    return np.ones((len(source), len(goal)), bool)


PLAIN = Costs(1, (Rule("ID", 0, _equal(str.lower)), Rule("S_ARB", 2, _always)))
# fixed values: names and costs of how a repair word takes up a reparandum word, over (word, POS) pairs
REPAIR = Costs(
    4,
    (
        Rule("REP", 0, _equal(lambda t: t[0])),
        Rule("REP_complete", 1, _fragment_in(0)),
        Rule("REP_partial", 1, _fragment_in(1)),
        Rule("SUB_POS", 2, _equal(lambda t: t[1])),
        Rule("SUB_POS_CLASS", 5, _equal(lambda t: t[1][:1])),
        Rule("S_ARB", 7, _always),
    ),
)


def _table(source: list, goal: list, costs: Costs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost of aligning all prefixes, substitution costs, number of the cheapest rule, the first of equals)."""
    every = np.stack([np.where(r.applies(source, goal), r.cost, np.iinfo(np.int32).max) for r in costs.rules]) if source and goal else np.zeros((1, len(source), len(goal)), np.int64)
    substitution, rule = every.min(axis=0), every.argmin(axis=0)
    steps = np.arange(len(goal) + 1) * costs.indel
    table = np.empty((len(source) + 1, len(goal) + 1), np.int64)
    table[0] = steps
    for i in range(1, len(source) + 1):
        best = np.minimum(table[i - 1, 1:] + costs.indel, table[i - 1, :-1] + substitution[i - 1])
        # an insertion adds one price a step, so a running minimum of what is left of it finds the best start of insertions
        table[i] = np.minimum.accumulate(np.r_[i * costs.indel, best] - steps) + steps
    return table, substitution, rule


def _moves(table: np.ndarray, substitution: np.ndarray, i: int, j: int, indel: int) -> list[tuple[int, int]]:
    """Steps back from a cell that cost what the table says: substitution, deletion, insertion."""
    out = []
    if i and j and table[i, j] == table[i - 1, j - 1] + substitution[i - 1, j - 1]:
        out.append((1, 1))
    if i and table[i, j] == table[i - 1, j] + indel:
        out.append((1, 0))
    if j and table[i, j] == table[i, j - 1] + indel:
        out.append((0, 1))
    return out


def best_alignments(source: list, goal: list, costs: Costs = PLAIN, most: int = 1) -> list[list[tuple[int, int, str, int]]]:
    """The first ``most`` of all best alignments, each a list of (source index, goal index, operation, cost so far). They are ranked from the end: a substitution
    before a deletion before an insertion."""
    table, substitution, rule = _table(source, goal, costs)
    out: list[list] = []
    # paths are linked from their last step, so branches share what they have in common
    waiting: list[tuple[int, int, tuple | None]] = [(len(source), len(goal), None)]
    while waiting and len(out) < most:
        i, j, path = waiting.pop()
        if not i and not j:
            out.append([])
            while path:
                out[-1].append(path[0])
                path = path[1]
            continue
        moves = _moves(table, substitution, i, j, costs.indel)
        for di, dj in reversed(moves[: most - len(out)]):
            name = costs.rules[rule[i - 1, j - 1]].name if di and dj else "DEL" if di else "INS"
            waiting.append((i - di, j - dj, ((max(0, i - 1), max(0, j - 1), name, int(table[i, j])), path)))
    return out


def match_blocks(source: list, goal: list, shortest: int = 1) -> list[tuple[int, int, int]]:
    """(source start, goal start, length) of common runs of at least ``shortest`` tokens: the longest run (of equals the leftmost in the source, then in the goal), then the same
    to its left and to its right."""
    same = _equal(lambda t: t)(source, goal)
    # runs[i, j]: length of the common run that ends before source i and goal j
    runs = np.zeros((len(source) + 1, len(goal) + 1), np.int64)
    for i in range(len(source)):
        runs[i + 1, 1:] = np.where(same[i], runs[i, :-1] + 1, 0)
    out, parts = [], [(0, len(source), 0, len(goal))]
    while parts:
        a, b, c, d = parts.pop()
        if a >= b or c >= d:
            continue
        inside = np.minimum(runs[a + 1 : b + 1, c + 1 : d + 1], np.minimum(np.arange(1, b - a + 1)[:, None], np.arange(1, d - c + 1)[None, :]))
        n = int(inside.max())
        if n < shortest or not n:
            continue
        i, j = (int(x) for x in np.unravel_index(inside.argmax(), inside.shape))
        start, goal_start = a + i + 1 - n, c + j + 1 - n
        out.append((start, goal_start, n))
        parts += [(a, start, c, goal_start), (start + n, b, goal_start + n, d)]
    return sorted(out)


def _mapped(df: DataFrame, columns: list[str], run, fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    kept = [c for c in df.columns if c not in columns]

    def go(batches):
        for batch in batches:
            values = [run(*r) for r in zip(*(batch.column(len(kept) + i).to_pylist() for i in range(len(columns))))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array([v[i] for v in values], t) for i, (_, t) in enumerate(fields))], names=[*kept, *(f for f, _ in fields)])

    schema = ", ".join([f"`{c}` {t}" for c, t in df.select(*kept).dtypes] + [ddl])
    return df.select(*kept, *columns).mapInArrow(go, schema)


def distances(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """``df`` with distance and wer in place of the two token arrays; null arrays read as empty."""

    def run(a, b):
        distance = token_distance(a or [], b or [])
        return distance, 100.0 * distance / len(a) if a else 100.0 if b else 0.0

    return _mapped(df, [reference, hypothesis], run, [("distance", pa.int32()), ("wer", pa.float64())], "distance int, wer double")


def alignments(df: DataFrame, source: str, goal: str) -> DataFrame:
    """``df`` with ``alignment`` (operations joined by blanks) and ``cost`` of the two token arrays."""

    def run(a, b):
        found = best_alignments(a or [], b or [])[0]
        return " ".join(f"{i}>{j}:{op}" for i, j, op, _ in found), found[-1][3] if found else 0

    return _mapped(df, [source, goal], run, [("alignment", pa.string()), ("cost", pa.int32())], "alignment string, cost int")


def ranked_alignments(df: DataFrame, source: str, goal: str, most: int) -> DataFrame:
    """``df`` with ``ranked``: the operations of the first ``most`` best alignments, in order."""

    def run(a, b):
        return ([" ".join(op for _, _, op, _ in found) for found in best_alignments(a or [], b or [], most=most)],)

    return _mapped(df, [source, goal], run, [("ranked", pa.list_(pa.string()))], "ranked array<string>")


def common_runs(df: DataFrame, source: str, goal: str, shortest: int = 1) -> DataFrame:
    """``df`` with ``blocks``: (source start, goal start, length) of the matching blocks of the two token arrays."""
    block = pa.struct([("source", pa.int32()), ("goal", pa.int32()), ("length", pa.int32())])

    def run(a, b):
        return ([dict(zip(("source", "goal", "length"), m)) for m in match_blocks(a or [], b or [], shortest)],)

    return _mapped(df, [source, goal], run, [("blocks", pa.list_(block))], "blocks array<struct<source:int,goal:int,length:int>>")


def repair_classes(df: DataFrame, reparandum: str, repair: str) -> DataFrame:
    """``df`` with ``operations`` and ``cost`` of arrays of (word, pos) structs."""

    def run(a, b):
        pairs = [[(x["word"], x["pos"]) for x in s or []] for s in (a, b)]
        found = best_alignments(*pairs, REPAIR)[0]
        return " ".join(op for _, _, op, _ in found), found[-1][3] if found else 0

    return _mapped(df, [reparandum, repair], run, [("operations", pa.string()), ("cost", pa.int32())], "operations string, cost int")


def shared_time(start: Column, end: Column, words: Column) -> Column:
    """(word, start, end) of the words that share an interval by their letters; whole numbers, the ends rounded down."""
    upto = F.aggregate(words, F.array(F.lit(0)), lambda done, w: F.concat(done, F.array(F.element_at(done, -1) + F.length(w))))

    def share(u: Column) -> Column:
        at = lambda i: (start + F.floor((end - start) * F.get(u, i) / F.greatest(F.lit(1), F.element_at(u, -1)))).cast("long")
        return F.transform(words, lambda w, i: F.struct(w.alias("word"), at(i).alias("start"), at(i + 1).alias("end")))

    # the sums are an element of an array, so that they are worked out once
    return F.element_at(F.transform(F.array(upto), share), 1)


#: Cells of the tables that are worked out together, and utterances at most.
CELLS, TOGETHER = 1 << 20, 512


def first_alignments(pairs: list[tuple[list, list]]) -> list[np.ndarray]:
    """For each (source, goal) the source index that each goal token is aligned with (unchanged or substituted) in the first of the best alignments, -1 if it is inserted: what ``best_alignments`` finds first at the costs ``PLAIN``, for many
    pairs of like size at once."""
    out: list = [None] * len(pairs)
    waiting = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    while waiting:
        n, m = 0, 0
        for size, k in enumerate(waiting[:TOGETHER]):
            n, m = max(n, len(pairs[k][0])), max(m, len(pairs[k][1]))
            if size and (size + 1) * (n + 1) * (m + 1) > CELLS:
                break
        else:
            size = min(TOGETHER, len(waiting))
        some, waiting = waiting[:size], waiting[size:]
        for k, found in zip(some, _aligned([pairs[k] for k in some])):
            out[k] = found
    return out


def _aligned(pairs: list[tuple[list, list]]) -> list[np.ndarray]:
    ids: dict = {}
    sizes = [np.array([len(p[side]) for p in pairs]) for side in (0, 1)]
    x, y = (np.full((len(pairs), sizes[side].max()), -1 - side) for side in (0, 1))
    for side, ends in ((0, x), (1, y)):
        for k, p in enumerate(pairs):
            ends[k, : len(p[side])] = [ids.setdefault(t.lower(), len(ids)) for t in p[side]]
    # cells within a pair's own sizes do not depend on what is padded behind them
    table = np.empty((x.shape[1] + 1, len(pairs), y.shape[1] + 1), np.int32)
    steps = np.arange(y.shape[1] + 1, dtype=np.int32)
    table[0] = steps
    for i in range(1, x.shape[1] + 1):
        row, before = table[i], table[i - 1]
        row[:, 0] = i
        row[:, 1:] = np.minimum(before[:, 1:] + 1, before[:, :-1] + np.where(x[:, i - 1, None] == y, 0, 2))
        # as in ``_table``: the best start of insertions
        row -= steps
        np.minimum.accumulate(row, axis=1, out=row)
        row += steps
    of = np.full((len(pairs), y.shape[1]), -1)
    k, (i, j) = np.arange(len(pairs)), (s.copy() for s in sizes)
    while len(k := k[(i[k] > 0) | (j[k] > 0)]):
        u, v = i[k], j[k]
        both, cost = (u > 0) & (v > 0), table[u, k, v]
        over = np.zeros(len(k), bool)
        b, p, q = k[both], u[both] - 1, v[both] - 1
        over[both] = cost[both] == table[p, b, q] + np.where(x[b, p] == y[b, q], 0, 2)
        of[k[over], v[over] - 1] = u[over] - 1
        deleted = ~over & (u > 0) & (cost == table[np.maximum(u - 1, 0), k, v] + 1)
        i[k] -= over | deleted
        j[k] -= ~deleted
    return [row[:size] for row, size in zip(of, sizes[1])]


def relabelled(df: DataFrame, source: str, goal: str, labels: str) -> DataFrame:
    """``df`` with ``carried``: for every token of ``goal`` the label of the source token that it is aligned with (unchanged or substituted), null for an inserted one."""
    kept = [c for c in df.columns if c not in (source, goal, labels)]

    def run(batches):
        for batch in sliced(batches):
            a, b, l = (batch.column(len(kept) + i).to_pylist() for i in range(3))
            found = first_alignments([(s or [], g or []) for s, g in zip(a, b)])
            carried = [[line[i] if i >= 0 else None for i in at.tolist()] for at, line in zip(found, l)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(carried, pa.list_(pa.string()))], names=[*kept, "carried"])

    schema = ", ".join([f"`{c}` {t}" for c, t in df.select(*kept).dtypes] + ["carried array<string>"])
    return df.select(*kept, source, goal, labels).mapInArrow(run, schema)
