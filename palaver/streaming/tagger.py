"""Incremental tagging of revocable word hypotheses.

An update revokes words from the right and adds new ones; it can also settle what was said so far (``commit``) or begin anew (``reset``). A session keeps what can still change and the
words that later tags may reach back to, whatever was said before; it re-decodes that and gives
the tags that changed. The same session runs in a batch replay, which reads sorted rows as a stream, and in Structured Streaming, where it is keyed state; output rows are
versioned: within a part (the updates between two resets) the tag of a position is that of its highest version, and positions at or above the ``length`` of the last version are gone. An
update that cannot be applied changes nothing and comes out as one row with its ``fault``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from palaver.operators.decoding import Lattice
from palaver.operators.repairs import MAX_BACK, eval_tags

#: Columns that can still be rolled back; what is older is settled.
HISTORY = 20
#: Words that emissions may look at, the current one included.
CONTEXT = 3
#: Settled words that are kept: an onset among the last MAX_BACK of them reaches back as far again.
SETTLED = 2 * MAX_BACK + CONTEXT
#: Settled words that are kept at most for the sake of a repair that has not ended.
OPEN_REPAIR = 200


class Hypothesis:
    """Words (word, start, end) of a recogniser, updated in place."""

    def __init__(self):
        self.words: list[tuple] = []

    def update(self, new: list[tuple]) -> tuple[list[tuple], int]:
        """(what was added, how many words were revoked). Words that end after the new
        ones start are revoked, unless the new ones repeat them; an update that only repeats changes nothing."""
        if not new:
            return [], 0
        keep = len(self.words)
        while keep and new[0][1] < self.words[keep - 1][2]:
            keep -= 1
        same = 0
        while same < len(new) and keep + same < len(self.words) and self.words[keep + same] == new[same]:
            same += 1
        added = new[same:]
        if not added:
            return [], 0
        revoked = len(self.words) - keep - same
        self.words[keep + same :] = added
        return added, revoked


class HypothesisIds:
    """Ids of recognised words: a word that starts behind the last one is new, a repeated one is ignored, an overlapping one takes the id of the
    first word that it revokes, and numbering goes on from there. ``commit`` forgets what the recogniser has settled."""

    def __init__(self):
        self.memory: list[tuple[float, float, str, int]] = []
        self.next_id, self.result_index = 0, 0

    def commit(self, result_index: int) -> None:
        if result_index > self.result_index:
            self.memory, self.result_index = [], result_index

    def see(self, word: str, start: float, end: float) -> int | None:
        if not self.memory or start >= self.memory[-1][1]:
            given = self.next_id
        else:
            if any(m[:3] == (start, end, word) for m in self.memory):
                return None
            given = None
            while self.memory and start < self.memory[-1][1]:
                given = self.memory.pop()[3]
        self.next_id = given + 1
        self.memory.append((start, end, word, given))
        return given


class TaggingSession:
    """What of one speaker's words can still change. ``emit(words)`` gives the log2 emissions of the last of the words over ``labels``; it sees the last CONTEXT words.

    ``base`` words were said before the ones that are kept; ``settled`` holds the labels of the kept words that are final, the lattice has a column for each of the others.
    State is bounded: HISTORY columns, SETTLED words before them (up to OPEN_REPAIR while a repair is open).
    """

    def __init__(self, labels: list[str], weights: dict, state_of: Callable, emit: Callable[[list[str]], list[float]], simple: bool = True):
        self.labels, self.emit, self.simple = labels, emit, simple
        self.lattice = Lattice(labels, weights, state_of)
        self.part = 0
        self._clear()

    def _clear(self) -> None:
        self.lattice.columns.clear()
        self.base, self.words, self.tags, self.settled, self.fixed = 0, [], [], [], 0

    @property
    def length(self) -> int:
        return self.base + len(self.words)

    def reset(self) -> None:
        """Begin a new part: nothing that was said before matters any more."""
        self._clear()
        self.part += 1

    def commit(self) -> None:
        """Settle all words: they cannot be revoked, and the best path so far is what later words follow."""
        path, _ = self.lattice.best()
        if path:
            self.settled += path[:-1]
            last = self.lattice.columns[-1]
            self.lattice.columns[:] = [[c if j == path[-1] else None for j, c in enumerate(last)]]
            self.fixed = 1
            self._forget()

    def revocable(self) -> int:
        return len(self.lattice.columns) - self.fixed

    def _forget(self) -> None:
        """Settle the oldest columns and drop the settled words that no tag to come can reach."""
        path, _ = self.lattice.best() if len(self.lattice.columns) > HISTORY else ([], 0.0)
        if path:
            n = len(self.lattice.columns) - HISTORY
            self.settled += path[:n]
            del self.lattice.columns[:n]
            self.fixed = 0
        surplus = len(self.settled) - SETTLED
        if surplus > 0 and (len(self.settled) >= OPEN_REPAIR or not self._open_before(surplus)):
            del self.words[:surplus], self.tags[:surplus], self.settled[:surplus]
            self.base += surplus

    def _open_before(self, n: int) -> bool:
        """Is a repair that begins among the first ``n`` kept words open behind them?"""
        is_open = False
        for label in self.settled[:n]:
            name = self.labels[label]
            is_open = ("<rm-" in name or is_open) and "<rpEnd" not in name
        return is_open

    def add(self, new: Iterable[str], rollback: int = 0) -> tuple[int, list[str], list[str]]:
        """(first changed position, words and tags from there on) after revoking ``rollback`` words and adding ``new``. An update that revokes more than can be raises
        ValueError and changes nothing."""
        if not 0 <= rollback <= self.revocable():
            raise ValueError(f"{rollback} words to revoke, but only {self.revocable()} can be")
        kept = len(self.words) - rollback
        before = list(self.tags)
        del self.words[kept:], self.tags[kept:]
        self.lattice.rollback(rollback)
        for word in new:
            self.words.append(word)
            self.lattice.step(self.emit(self.words[-CONTEXT:]))
        path, _ = self.lattice.best()
        if len(self.settled) + len(path) == len(self.words):
            # settled words further back than a repair can reach keep the tags that they have
            keep = max(0, len(self.settled) - MAX_BACK) if self.base else 0
            self.tags = before[:keep] + eval_tags([self.labels[i] for i in self.settled + path], self.words, self.simple, self.base)[keep:]
        else:  # no path is allowed: new words stay without a tag
            self.tags = before[:kept] + [""] * (len(self.words) - kept)
        changed = next((i for i, (a, b) in enumerate(zip(before, self.tags)) if a != b), min(len(before), len(self.tags)))
        result = self.base + changed, self.words[changed:], self.tags[changed:]
        self._forget()
        return result

    def dump(self) -> str:
        return json.dumps([self.part, self.base, self.words, self.tags, self.settled, self.fixed, self.lattice.columns])

    def load(self, text: str) -> None:
        self.part, self.base, self.words, self.tags, self.settled, self.fixed, columns = json.loads(text)
        self.lattice.columns = [[None if c is None else tuple(c) for c in column] for column in columns]


def arg_max_tags(words: list[str], labels: list[str], emit: Callable[[list[str]], list[float]]) -> list[str]:
    """Tags without a decoder: the likeliest label of each word, from the last CONTEXT words."""
    out = []
    for i in range(len(words)):
        e = emit(words[max(0, i + 1 - CONTEXT) : i + 1])
        out.append(labels[max(range(len(labels)), key=lambda j: (e[j], -j))])
    return out


UPDATE_FIELDS = ["key", "update_no", "rollback", "words"]
OUTPUT = "key string, version long, part int, length int, idx int, word string, tag string, fault string"
_COLUMNS = [f.split()[0] for f in OUTPUT.split(", ")]


def _updates(updates: DataFrame) -> DataFrame:
    """The fields of updates; ``control`` (``commit`` or ``reset``, before the words) may be missing."""
    control = F.col("control") if "control" in updates.columns else F.lit(None).cast("string")
    return updates.select(*UPDATE_FIELDS, control.alias("control"))


def _apply(session: TaggingSession, row: dict) -> list[tuple]:
    key, version, control, rollback = row["key"], int(row["update_no"]), row["control"], int(row["rollback"] or 0)
    try:
        if control not in (None, "reset", "commit"):
            raise ValueError(f"unknown control {control}")
        if control and rollback:
            raise ValueError(f"{rollback} words to revoke behind a {control}")
        if control:
            session.reset() if control == "reset" else session.commit()
        before = session.length
        first, words, tags = session.add(list(row["words"]) if row["words"] is not None else [], rollback)
    except ValueError as fault:
        return [(key, version, session.part, session.length, None, None, None, str(fault))]
    out = [(key, version, session.part, session.length, first + i, w, t, None) for i, (w, t) in enumerate(zip(words, tags))]
    # an update that only revokes still says how long the hypothesis is
    return out or ([(key, version, session.part, session.length, None, None, None, None)] if session.length < before else [])


def by_key(rows: DataFrame, key: str, order: list[str], start: Callable, schema: str) -> DataFrame:
    """Rows of a key in order, read as a stream: ``start()`` gives an object per key whose ``row(dict)`` and ``close(key)`` return output tuples. A key's rows are never held together."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        kinds = None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if state is None or row[key] != current:
                    out += state.close(current) if state is not None else []
                    current, state = row[key], start()
                out += state.row(row)
            kinds = kinds or _arrow(schema)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        last = state.close(current) if state is not None else []
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*last), _arrow(schema))], names=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _arrow(schema: str) -> list[pa.DataType]:
    kinds = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return [kinds[f.split()[1]] for f in schema.split(", ")]


class _Replayed:
    def __init__(self, session: TaggingSession):
        self.session = session

    def row(self, row: dict) -> list[tuple]:
        return _apply(self.session, row)

    def close(self, key) -> list[tuple]:
        return []


def replay(updates: DataFrame, make_session: Callable[[], TaggingSession]) -> DataFrame:
    """Tag rows of a whole update log (key, update_no, rollback, words, control), a key's updates in order."""
    return by_key(_updates(updates), "key", ["update_no"], lambda: _Replayed(make_session()), OUTPUT)


def tag_stream(updates: DataFrame, make_session: Callable[[], TaggingSession], idle: str | None = None) -> DataFrame:
    """The same rows from a stream of updates. State: what of a session can still change. With ``idle`` (a duration) a key that
    stays idle is forgotten; Spark then runs batches without data too, so such a stream is for continuous triggers. Within a
    micro-batch a key's updates are taken in order of ``update_no``."""
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = make_session()
        if state.exists:
            session.load(state.get[0])
        rows = list(frames)
        out = [o for row in (pd.concat(rows).sort_values("update_no").to_dict("records") if rows else []) for o in _apply(session, row)]
        state.update((session.dump(),))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"part": "Int32", "length": "Int32", "idx": "Int32"})

    return _updates(updates).groupBy("key").applyInPandasWithState(run, OUTPUT, "session string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def faults(rows: DataFrame) -> DataFrame:
    """Updates that could not be applied: key, version, fault."""
    return rows.filter("fault is not null").select("key", "version", "fault")


def final_view(rows: DataFrame) -> DataFrame:
    """The tags that stand: in each part the highest version of each position below the length of the part's last version."""
    # both windows read the same sort
    whole = Window.partitionBy("key", "part").orderBy("idx", F.col("version").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    newest = Window.partitionBy("key", "part", "idx").orderBy(F.col("version").desc())
    good = rows.filter("fault is null").withColumn("__last", F.max(F.struct("version", "length")).over(whole)["length"]).withColumn("__n", F.row_number().over(newest))
    return good.filter((F.col("idx") < F.col("__last")) & (F.col("__n") == 1)).select("key", "part", "idx", "word", "tag")


class _Logged:
    def __init__(self, columns: tuple[str, str, str]):
        self.columns, self.hypothesis, self.n = columns, Hypothesis(), 0

    def row(self, row: dict) -> list[tuple]:
        added, revoked = self.hypothesis.update([tuple(row[c] for c in self.columns)])
        self.n += 1
        return [(row["key"], self.n - 1, revoked, len(self.hypothesis.words), added[0][0] if added else None)]

    def close(self, key) -> list[tuple]:
        return []


def hypothesis_log(words: DataFrame, key: str, order: str, columns: tuple[str, str, str] = ("word", "start", "end")) -> DataFrame:
    """key, update_no, rollback, length and the added word from a sequence of single recognised words, by the prefix rule; a key's words are read in order."""
    kind = words.schema[key].dataType.simpleString()
    return by_key(words.select(F.col(key).alias("key"), order, *columns), "key", [order], lambda: _Logged(columns), f"key {kind}, update_no long, rollback int, length int, word string")


class _Numbered:
    def __init__(self):
        self.ids, self.n_words, self.n_messages, self.last = HypothesisIds(), 0, 0, -1

    def row(self, row: dict) -> list[tuple]:
        self.ids.commit(row["result_index"])
        given = self.ids.see(row["word"], row["start"], row["end"])
        self.n_words += 1
        if given is not None:
            self.n_messages, self.last = self.n_messages + 1, max(self.last, given)
        return []

    def close(self, key) -> list[tuple]:
        return [(key, self.n_words, self.n_messages, self.last + 1)]


def hypothesis_ids(words: DataFrame, key: str, order: str) -> DataFrame:
    """key, n_words, n_messages (words that are no repeats) and n_ids of recogniser words (result_index, word, start, end) numbered by the overlap rule, a key's words in order."""
    kind = words.schema[key].dataType.simpleString()
    return by_key(words.select(F.col(key).alias("key"), order, "result_index", "word", "start", "end"), "key", [order], _Numbered, f"key {kind}, n_words long, n_messages long, n_ids long")


def gap_sessions(df: DataFrame, by: list[str], at: str, gap_s: float) -> DataFrame:
    """Session numbers by pauses of more than ``gap_s`` seconds."""
    w = Window.partitionBy(*by).orderBy(at)
    pause = F.col(at).cast("double") - F.lag(at).over(w).cast("double")
    return df.withColumn("__new", F.when(pause > gap_s, 1).otherwise(0)).withColumn("session", F.sum("__new").over(w)).drop("__new")


def windowed_counts(df: DataFrame, at: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """Tumbling window counts, for tables and (with ``late`` as watermark) streams."""
    rows = df.withWatermark(at, late) if late else df
    return rows.groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def session_counts(df: DataFrame, at: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts by session windows, for tables and streams."""
    rows = df.withWatermark(at, late) if late else df
    return rows.groupBy(F.session_window(at, gap), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n")
