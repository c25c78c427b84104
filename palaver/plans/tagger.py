"""A tagger as one value: labels, transitions and emissions, for utterance batches, update logs and streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators import decoding
from palaver.sources import readers, writers
from palaver.streaming import tagger as live


@dataclass(frozen=True)
class Tagger:
    """``labels`` with the Markov state of each (``state_of(previous state, label)``), log2 transition ``weights``, and ``emit(words)``: log2
    emissions of the last word. ``simple``: onsets only, no reparanda."""

    labels: tuple[str, ...]
    state_of: Callable[[str, str], str | None]
    emit: Callable[[list[str]], list[float]] | None = None
    weights: dict = field(default_factory=decoding.constraint_weights)
    simple: bool = True

    def session(self) -> live.TaggingSession:
        return live.TaggingSession(list(self.labels), self.weights, self.state_of, self.emit, self.simple)

    def decode(self, utterances: DataFrame, emissions: str = "emissions", end_weights: dict[str, float] | None = None) -> DataFrame:
        """One row per utterance with its emissions -> path and score."""
        return decoding.viterbi(utterances, list(self.labels), self.weights, emissions, self.state_of, end_weights)

    def replay(self, updates: DataFrame) -> DataFrame:
        return live.replay(updates, self.session)

    def stream(self, updates: DataFrame, idle: str | None = None) -> DataFrame:
        return live.tag_stream(updates, self.session, idle)

    def tag_files(self, spark: SparkSession, source: str, target: str) -> None:
        """Timed corpus files, word by word, to an update log: every update holds the words whose tags changed."""
        rows = readers.timed_corpus(spark, source, limit=False)
        updates = rows.select(F.col("speaker").alias("key"), F.col("pos").alias("update_no"), F.lit(0).alias("rollback"), F.array("word").alias("words"))
        changed = self.replay(updates).filter("fault is null").select(F.col("key").alias("speaker"), F.col("version").alias("update_no"), F.col("idx").cast("long").alias("pos"), "tag")
        times = rows.select("speaker", F.col("pos").alias("update_no"), F.col("end").alias("update_time"))
        log = changed.join(rows.select("speaker", "pos", "start", "end", "word", "pos_tag"), ["speaker", "pos"]).join(times, ["speaker", "update_no"])
        writers.write_text(writers.increco(log.withColumnRenamed("pos", "pos_in_update")), target, ["speaker"], ("update_no",))

    def with_transitions(self, states: DataFrame, by: list[str], order: str) -> Tagger:
        """The tagger with transition probabilities counted on a table of states; the table of state pairs is bounded by the label set."""
        import math

        rows = decoding.transition_probabilities(decoding.transition_counts(states, by, order)).collect()
        return Tagger(self.labels, self.state_of, self.emit, {(r["prev"], r["next"]): math.log2(r["p"]) for r in rows}, self.simple)
