"""Markov models over tag states and Viterbi decoding.

Transitions are a table (prev, next, weight); decoding reads one row per utterance with its emissions and never shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "s", "se"
# fixed values: which states may follow which in the joint repair and segmentation scheme; the row is the state before
STATES = ("c_f_c", "c_e_c", "t_f_c", "t_e_c", "t_f_t", "t_e_t", "c_f_t", "c_e_t", "c_rpSE_c", "c_rpSE_t", "c_i_c")
MAY_FOLLOW = {
    "c_f_c": ("c_f_c", "c_e_c", "c_f_t", "c_e_t", "c_rpSE_c", "c_rpSE_t", "c_i_c"),
    "c_e_c": ("c_f_c", "c_e_c", "c_f_t", "c_e_t"),
    "t_f_c": ("c_f_c", "c_e_c", "c_f_t", "c_e_t", "c_rpSE_c", "c_rpSE_t", "c_i_c"),
    "t_e_c": ("c_f_c", "c_e_c", "c_f_t", "c_e_t"),
    "t_f_t": ("t_f_c", "t_e_c", "t_f_t", "t_e_t"),
    "t_e_t": ("t_f_c", "t_e_c", "t_f_t", "t_e_t"),
    "c_f_t": ("t_f_c", "t_e_c", "t_f_t", "t_e_t"),
    "c_e_t": ("t_f_c", "t_e_c", "t_f_t", "t_e_t"),
    "c_rpSE_c": ("c_f_c", "c_e_c", "c_f_t", "c_e_t", "c_rpSE_c", "c_rpSE_t", "c_i_c"),
    "c_rpSE_t": ("t_f_c", "t_e_c", "t_f_t", "t_e_t"),
    "c_i_c": ("c_rpSE_c", "c_rpSE_t", "c_i_c"),
    "s": ("t_f_c", "t_e_c", "t_f_t", "t_e_t"),
}
# fixed values: multipliers of rare states
BOOST_REPAIR_START, BOOST_REPAIR_END, BOOST_FIRST, BOOST_LAST = 4.0, 2.0, 3.0, 3.0


#: Numbers of the lattices that are ranked together, and utterances whose emissions are read together.
PATH_CELLS, READ_ROWS = 1 << 22, 256


def boost(state: str) -> float:
    low = state.lower()
    return (BOOST_REPAIR_START if "rps" in low else 1.0) * (BOOST_REPAIR_END if "rpe" in low else 1.0) * (BOOST_FIRST if low[:2] == "t_" else 1.0) * (BOOST_LAST if "_t" in low else 1.0)


def constraint_weights(may_follow: dict[str, tuple[str, ...]] = MAY_FOLLOW, boosts: bool = True) -> dict[tuple[str, str], float]:
    """log2 weights: allowed transitions weigh 1, times the boosts of the state that is entered except from the start."""
    return {(p, n): math.log2(boost(n)) if boosts and p != START else 0.0 for p, ns in may_follow.items() for n in ns}


def transition_counts(df: DataFrame, by: list[str], order: str, state: str = "state", with_end: bool = True) -> DataFrame:
    """(prev, next, n) with a start state, and an end state if ``with_end``."""
    w = Window.partitionBy(*by).orderBy(order)
    steps = df.select(F.coalesce(F.lag(state).over(w), F.lit(START)).alias("prev"), F.col(state).alias("next"), F.lead(state).over(w).isNull().alias("last"))
    if with_end:
        steps = steps.select(F.explode(F.when(F.col("last"), F.array(F.struct("prev", "next"), F.struct(F.col("next").alias("prev"), F.lit(END).alias("next")))).otherwise(F.array(F.struct("prev", "next")))).alias("s")).select("s.*")
    return steps.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"))


def transition_probabilities(counts: DataFrame) -> DataFrame:
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def interregna(df: DataFrame, by: list[str], order: str, state: str = "state") -> DataFrame:
    """Edit terms in a run right before a repair onset become interregna (``e`` to ``i`` inside the state)."""
    back = Window.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    is_edit = F.col(state).rlike("(^|_)e(_|$)")
    following = F.last(F.when(~is_edit, F.col(state)), ignorenulls=True).over(back)
    return df.withColumn(state, F.when(is_edit & F.coalesce(following.contains("rpS"), F.lit(False)), F.regexp_replace(state, "(^|_)e(_|$)", "$1i$2")).otherwise(F.col(state)))


def matrix_to_counts(matrix: DataFrame, prev: str = "prev") -> DataFrame:
    """A wide 0/1 matrix as (prev, next, n) without the zeros."""
    columns = [c for c in matrix.columns if c != prev]
    return matrix.unpivot(prev, columns, "next", "n").filter("n > 0").select(F.col(prev).alias("prev"), "next", "n")


def counts_to_matrix(counts: DataFrame, states: list[str]) -> DataFrame:
    return counts.groupBy("prev").pivot("next", states).agg(F.sum("n"))


def argmax_label(emissions: Column) -> Column:
    """Index of the largest emission, the first one on ties."""
    return F.array_position(emissions, F.array_max(emissions)) - 1


class Lattice:
    """Viterbi columns of one sequence. ``state_of(previous state, label)`` names the Markov state that a label gives; on ties the label with
    the lower index wins. ``step`` adds a column, ``rollback`` drops columns, ``best`` gives the labels of the best path."""

    def __init__(self, labels: list[str], weights: dict[tuple[str, str], float], state_of: Callable[[str, str], str | None]):
        self.labels, self.weights, self.state_of = labels, weights, state_of
        self.columns: list[list[tuple[float, int, str] | None]] = []
        self._moves: dict[str, list[tuple[int, str, float]]] = {}

    def moves(self, state: str) -> list[tuple[int, str, float]]:
        """(label, state entered, weight) of what may follow a state, worked out once a state."""
        if state not in self._moves:
            entered = [self.state_of("" if state == START else state, label) for label in self.labels]
            self._moves[state] = [(j, e, self.weights[state, e]) for j, e in enumerate(entered) if e and self.weights.get((state, e)) is not None]
        return self._moves[state]

    def step(self, log_emissions) -> None:
        emissions = [float(e) for e in log_emissions]
        column: list[tuple[float, int, str] | None] = [None] * len(self.labels)
        totals = [-math.inf] * len(self.labels)
        before = self.columns[-1] if self.columns else None
        sources = [(0.0, -1, START)] if before is None else [(c[0], i, c[2]) for i, c in enumerate(before) if c is not None]
        for score, i, state in sources:
            for j, entered, weight in self.moves(state):
                total = score + weight + emissions[j]
                if total > totals[j]:
                    totals[j], column[j] = total, (total, i, entered)
        self.columns.append(column)

    def rollback(self, n: int) -> None:
        del self.columns[len(self.columns) - n :]

    def best(self, end_weights: dict[str, float] | None = None) -> tuple[list[int], float]:
        """Label indices of the best path and its score; no labels if nothing is allowed."""
        if not self.columns:
            return [], 0.0
        ends = [(c[0] + (0.0 if end_weights is None else end_weights.get(c[2], -math.inf)), -j) for j, c in enumerate(self.columns[-1]) if c is not None]
        ends = [e for e in ends if e[0] > -math.inf]
        if not ends:
            return [], -math.inf
        score, at = max(ends)
        at, path = -at, []
        for column in reversed(self.columns):
            path.append(at)
            at = column[at][1]
        return path[::-1], score


def sliced(batches):
    """Parts of the batches with so few rows that the Python numbers of their emissions are no matter."""
    for batch in batches:
        for at in range(0, batch.num_rows, READ_ROWS):
            yield batch.slice(at, READ_ROWS)


def viterbi(df: DataFrame, labels: list[str], weights: dict[tuple[str, str], float], emissions: str = "emissions", state_of: Callable[[str, str], str | None] | None = None, end_weights: dict[str, float] | None = None) -> DataFrame:
    """``df`` (one row per utterance, ``emissions``: array of log2 emission arrays) with ``path`` (label indices) and ``score``.

    Where a label is its own state, columns are computed by matrix operations; otherwise states follow ``state_of``.
    """
    kept = [c for c in df.columns if c != emissions]
    matrix = np.full((len(labels) + 1, len(labels)), -np.inf)
    for j, n in enumerate(labels):
        for i, p in enumerate([*labels, START]):
            matrix[i, j] = weights.get((p, n), -np.inf)

    def fast(rows: np.ndarray) -> tuple[list[int], float]:
        score, back = matrix[-1] + rows[0], []
        for row in rows[1:]:
            through = score[:, None] + matrix[:-1] + row[None, :]
            back.append(through.argmax(axis=0))
            score = through.max(axis=0)
        if end_weights is not None:
            score = score + np.array([end_weights.get(s, -np.inf) for s in labels])
        at = int(score.argmax())
        if score[at] == -np.inf:
            return [], -math.inf
        path = [at]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1], float(score[at])

    def slow(rows: np.ndarray) -> tuple[list[int], float]:
        lattice = Lattice(labels, weights, state_of)
        for row in rows:
            lattice.step(row)
        return lattice.best(end_weights)

    def run(batches):
        for batch in sliced(batches):
            paths, scores = [], []
            for rows in batch.column(len(kept)).to_pylist():
                path, score = (fast if state_of is None else slow)(np.array(rows, float)) if rows else ([], 0.0)
                paths.append(path)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(paths, pa.list_(pa.int32())), pa.array(scores, pa.float64())], names=[*kept, "path", "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*kept).dtypes) + ", path array<int>, score double"
    return df.select(*kept, emissions).mapInArrow(run, schema)


def best_paths(df: DataFrame, labels: list[str], weights: dict[tuple[str, str], float], n: int, emissions: str = "emissions", end_weights: dict[str, float] | None = None) -> DataFrame:
    """``df`` (one row per utterance) with ``paths``: the best path to each of the ``n`` best last labels, best first, with its score; ties go to the label with the lower index. Fewer
    where fewer labels can end the utterance."""
    kept = [c for c in df.columns if c != emissions]
    matrix = np.array([[weights.get((p, q), -np.inf) for q in labels] for p in [*labels, START]])
    ends = np.array([0.0 if end_weights is None else end_weights.get(s, -np.inf) for s in labels])
    kind = pa.list_(pa.struct([("path", pa.list_(pa.int32())), ("score", pa.float64())]))

    def ranked(rows: np.ndarray) -> list[dict]:
        score, back = matrix[-1] + rows[0], []
        for row in rows[1:]:
            through = score[:, None] + matrix[:-1] + row[None, :]
            back.append(through.argmax(axis=0))
            score = through.max(axis=0)
        score = score + ends
        out = []
        for at in np.argsort(-score, kind="stable")[:n]:
            if score[at] == -np.inf:
                break
            path = [int(at)]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            out.append({"path": path[::-1], "score": float(score[at])})
        return out

    def run(batches):
        for batch in sliced(batches):
            found = [ranked(np.array(rows, float)) if rows else [] for rows in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, kind)], names=[*kept, "paths"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*kept).dtypes) + ", paths array<struct<path:array<int>,score:double>>"
    return df.select(*kept, emissions).mapInArrow(run, schema)


def n_best_paths(df: DataFrame, labels: list[str], weights: dict[tuple[str, str], float], n: int, emissions: str = "emissions", end_weights: dict[str, float] | None = None) -> DataFrame:
    """``df`` (one row per utterance) with ``paths``: its ``n`` best label paths with their scores, best first; fewer where fewer are allowed. Emissions of -inf forbid a label.

    Every cell of the lattice holds the best ``n`` ways to reach it, merged from the ranked ways to all cells before it, so ``n`` may exceed the number of labels. Equal scores go to the
    path whose last label has the lower index, then to the one whose last but one has, and so on. An utterance needs words x labels x ``n`` numbers of memory; short ones are decoded together up to ``PATH_CELLS`` of them.
    """
    kept = [c for c in df.columns if c != emissions]
    size = len(labels)
    matrix = np.array([[weights.get((p, q), -np.inf) for q in labels] for p in [*labels, START]])
    ends = np.array([0.0 if end_weights is None else end_weights.get(s, -np.inf) for s in labels])
    sources = [np.flatnonzero(matrix[:-1, j] > -np.inf) for j in range(size)]
    place = np.int16 if size * n < 1 << 15 else np.int32

    def first(scores: np.ndarray) -> np.ndarray:
        """Places of the ``n`` largest scores of each row, in order; of equal ones the first."""
        return np.argsort(-scores, axis=1, kind="stable")[:, :n]

    def ranked(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths (utterance, rank, word) and their scores; -inf where there is none. ``rows``: emissions (utterance, word, label) of utterances of falling lengths."""
        # ways[u, j, r]: score of the r-th best way of an utterance to label j; a way is known by its place j * n + r
        ways = np.full((len(rows), size, n), -np.inf)
        ways[:, :, 0] = matrix[-1] + rows[:, 0]
        backs, going = [], [int((lengths > t).sum()) for t in range(rows.shape[1])]
        for t, live in enumerate(going[1:], 1):
            grown, back = np.full((live, size, n), -np.inf), np.zeros((live, size, n), place)
            for j, of in enumerate(sources):
                if of.size:
                    through = ((ways[:live, of] + matrix[of, j, None]) + rows[:live, t, j, None, None]).reshape(live, -1)
                    through[np.isnan(through)] = -np.inf
                    best = first(through)
                    grown[:, j, : best.shape[1]] = np.take_along_axis(through, best, 1)
                    back[:, j, : best.shape[1]] = of[best // n] * n + best % n
            ways[:live] = grown
            backs.append(back.reshape(live, -1))
        every = (ways + ends[:, None]).reshape(len(rows), -1)
        at = first(every)
        paths = np.zeros((*at.shape, rows.shape[1]), np.int32)
        scores = np.take_along_axis(every, at, 1)
        for t in reversed(range(rows.shape[1])):
            live = going[t]
            paths[:live, :, t] = at[:live] // n
            if t:
                at[:live] = np.take_along_axis(backs[t - 1], at[:live], 1)
        return paths, scores

    def run(batches):
        for whole in batches:
            cells = max(1, PATH_CELLS // (size * n))
            every = pc.list_value_length(whole.column(len(kept))).fill_null(0).to_numpy(zero_copy_only=False)
            # neighbours in the table that together have some thousands of words are decoded together, a word of each at a time
            cuts = np.flatnonzero(np.diff(np.cumsum(every) // cells)) + 1
            for a, b in zip([0, *cuts], [*cuts, whole.num_rows]):
                batch, lengths = whole.slice(a, b - a), every[a:b]
                flat = batch.column(len(kept)).flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                starts = np.cumsum(lengths) - lengths
                order = np.argsort(-lengths, kind="stable")
                found: list = [(np.empty((0, 0), np.int32), np.empty(0))] * len(lengths)
                order = order[lengths[order] > 0]
                at = 0
                while at < order.size:
                    some = order[at : at + max(1, cells // lengths[order[at]])]
                    at += some.size
                    rows = np.full((some.size, lengths[some[0]], size), -np.inf)
                    for u, k in enumerate(some):
                        rows[u, : lengths[k]] = flat[starts[k] : starts[k] + lengths[k]]
                    rows[np.isnan(rows)] = -np.inf
                    for k, path, score in zip(some, *ranked(rows, lengths[some])):
                        allowed = score > -np.inf
                        found[k] = (path[allowed, : lengths[k]], score[allowed])
                sizes = np.array([score.size for _, score in found])
                ends_at = np.cumsum(np.repeat(lengths, sizes))
                paths = pa.ListArray.from_arrays(pa.array(np.r_[0, ends_at].astype(np.int32)), pa.array(np.concatenate([p.ravel() for p, _ in found])))
                structs = pa.StructArray.from_arrays([paths, pa.array(np.concatenate([x for _, x in found]))], names=["path", "score"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), structs)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], lists], names=[*kept, "paths"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*kept).dtypes) + ", paths array<struct<path:array<int>,score:double>>"
    return df.select(*kept, emissions).mapInArrow(run, schema)


def timing_weight(log_emission: Column, is_first: Column, p_first: Column, weight: float = 2.0) -> Column:
    """An emission with the timing classifier's opinion: weight * P(class) + weight multiplies the transition."""
    p = F.when(is_first, p_first).otherwise(1 - p_first)
    return log_emission + F.log2(F.lit(weight) * p + F.lit(weight))
