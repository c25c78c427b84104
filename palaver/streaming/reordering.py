"""Tagging a stream whose updates arrive out of order: a buffer in keyed state that releases updates by event time.

``tag_stream`` takes updates as they arrive. Here they wait in a map state, ordered by their time and number, until the watermark has passed them (an event-time timer wakes the key), and are then applied in order; so a shuffled stream
gives the rows of the ordered replay. State of a key: its session (what can still change), the place of the last update released, and the updates that wait. The RocksDB state store keeps the map as single entries, so a key may hold
many of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .tagger import _COLUMNS, OUTPUT, UPDATE_FIELDS, TaggingSession, _apply

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Reordering(StatefulProcessor):
    def __init__(self, make_session: Callable[[], TaggingSession]):
        self.make_session = make_session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "session string")
        self.released = handle.getValueState("released", "at_ms long, update_no long")
        self.waiting = handle.getMapState("waiting", "at_ms long, update_no long", "rollback int, words array<string>, control string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.released.get()) if self.released.exists() else None
        late = []
        for frame in rows:
            for row in frame.to_dict("records"):
                place = int(row["at_ms"]), int(row["update_no"])
                if last is not None and place <= last:
                    late.append((key[0], place[1], None, None, None, None, None, "late"))
                    continue
                words = row["words"]
                self.waiting.updateValue(place, (None if pd.isna(row["rollback"]) else int(row["rollback"]), None if words is None else [str(w) for w in words], row["control"]))
                self.handle.registerTimer(place[0])
        yield _frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted((tuple(place) for place in self.waiting.keys() if place[0] <= passed)) if self.waiting.exists() else []
        out = []
        if due:
            session = self.make_session()
            if self.session.exists():
                session.load(self.session.get()[0])
            for place in due:
                rollback, words, control = self.waiting.getValue(place)
                out += _apply(session, {"key": key[0], "update_no": place[1], "rollback": rollback, "words": words, "control": control})
                self.waiting.removeKey(place)
            self.session.update((session.dump(),))
            self.released.update(due[-1])
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"version": "Int64", "part": "Int32", "length": "Int32", "idx": "Int32"})


def use_rocksdb(spark: SparkSession) -> None:
    """Map state and timers need the RocksDB state store."""
    spark.conf.set(STORE, ROCKSDB)


def tag_stream_in_order(updates: DataFrame, make_session: Callable[[], TaggingSession], at: str, delay: str) -> DataFrame:
    """Tag rows as of ``tagger.replay`` from a stream of updates (key, update_no, rollback, words, control, and the timestamp ``at``) in any order of arrival.

    An update is applied once the watermark, ``delay`` behind the latest time seen, has reached its time; those of a key in order of time and number. What comes later than the watermark is dropped by Spark and counted in the query's
    progress; what is no later but stands before an update already applied is a row with the fault ``late``. An update that is sent twice is applied once. The stream's last ``delay`` stays in state until later updates arrive.
    """
    fields = [*UPDATE_FIELDS, "control"]
    known = updates if "control" in updates.columns else updates.withColumn("control", F.lit(None).cast("string"))
    with_time = known.select(F.col(at).alias("at"), *fields)
    rows = with_time.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy("key").transformWithStateInPandas(_Reordering(make_session), OUTPUT, "Append", "EventTime")
