"""Recurrent taggers in numpy: forward passes for inference on the workers, a small training loop on the driver, and the timing
classifier. Weights are plain arrays and go to the workers once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler, Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.sources.shared import materialised

from .decoding import sliced


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def window_input(words: np.ndarray, pos: np.ndarray, embeddings: np.ndarray, n_pos: int, extra: np.ndarray | None = None) -> np.ndarray:
    """One time step: the embeddings of a window of word ids (-1 pads and is zero), the window's POS ids one-hot, and extra numbers."""
    e = np.where((words >= 0)[:, None], embeddings[np.maximum(words, 0)], 0.0).ravel()
    one_hot = np.zeros((pos.size, n_pos))
    one_hot[np.arange(pos.size)[pos >= 0], pos[pos >= 0]] = 1.0
    return np.concatenate([e, one_hot.ravel(), extra if extra is not None else np.empty(0)])


@dataclass
class Elman:
    """h = sigmoid(x Wx + h' Wh + bh); softmax(h W + b)."""

    wx: np.ndarray
    wh: np.ndarray
    bh: np.ndarray
    w: np.ndarray
    b: np.ndarray
    h0: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.h0 is None:
            self.h0 = np.zeros(self.bh.shape)

    def start(self):
        return (self.h0,)

    def step(self, x: np.ndarray, state):
        h = _sigmoid(x @ self.wx + state[0] @ self.wh + self.bh)
        return (h,), _softmax(h @ self.w + self.b)


@dataclass
class PeepholeLstm:
    """Input and forget gates see the cell before, the output gate sees the new cell. ``wx``, ``wh``, ``b``: dicts by i, f, c, o; ``wc``: by i, f, o."""

    wx: dict
    wh: dict
    wc: dict
    b: dict
    w: np.ndarray
    wb: np.ndarray

    def start(self):
        n = self.b["c"].shape[0]
        return np.zeros(n), np.zeros(n)

    def step(self, x: np.ndarray, state):
        h, c = state
        gate = lambda k, cell: _sigmoid(x @ self.wx[k] + h @ self.wh[k] + cell @ self.wc[k] + self.b[k])
        i, f = gate("i", c), gate("f", c)
        new = f * c + i * np.tanh(x @ self.wx["c"] + h @ self.wh["c"] + self.b["c"])
        h = gate("o", new) * np.tanh(new)
        return (h, new), _softmax(h @ self.w + self.wb)


def run_network(model, inputs: np.ndarray) -> np.ndarray:
    """Softmax rows of a sequence of input vectors."""
    state, out = model.start(), []
    for x in inputs:
        state, y = model.step(x, state)
        out.append(y)
    return np.array(out)


def random_elman(n_in: int, n_hidden: int, n_out: int, seed: int = 0) -> Elman:
    r = np.random.default_rng(seed)
    draw = lambda *s: r.uniform(-0.2, 0.2, s)
    return Elman(draw(n_in, n_hidden), draw(n_hidden, n_hidden), np.zeros(n_hidden), draw(n_hidden, n_out), np.zeros(n_out))


def random_lstm(n_in: int, n_hidden: int, n_out: int, seed: int = 0) -> PeepholeLstm:
    r = np.random.default_rng(seed)
    draw = lambda *s: r.uniform(-0.2, 0.2, s)
    return PeepholeLstm({k: draw(n_in, n_hidden) for k in "ifco"}, {k: draw(n_hidden, n_hidden) for k in "ifco"}, {k: draw(n_hidden, n_hidden) for k in "ifo"}, {k: np.zeros(n_hidden) for k in "ifco"}, draw(n_hidden, n_out), np.zeros(n_out))


def fit_elman(model: Elman, sequences: list[tuple[np.ndarray, np.ndarray]], rate: float = 0.1, l2: float = 1e-5, epochs: int = 50, decay: float = 0.85, decay_after: int = 2, patience: int = 10, least_rate: float = 1e-5) -> list[float]:
    """Stochastic gradient descent through time, sequence by sequence; the rate decays after ``decay_after`` epochs without gain and training stops after
    ``patience`` of them. Returns the mean loss of each epoch. Training is sequential by nature: for samples that fit the driver."""
    losses, best, since = [], np.inf, 0
    for _ in range(epochs):
        total = 0.0
        for x, labels in sequences:
            hs, ys = [model.h0], []
            for row in x:
                (h,), y = model.step(row, (hs[-1],))
                hs.append(h)
                ys.append(y)
            g = {k: np.zeros_like(getattr(model, k)) for k in ("wx", "wh", "bh", "w", "b")}
            back = np.zeros_like(model.bh)
            for t in range(len(x) - 1, -1, -1):
                d = ys[t].copy()
                total -= np.log(d[labels[t]] + 1e-12)
                d[labels[t]] -= 1.0
                g["w"] += np.outer(hs[t + 1], d)
                g["b"] += d
                dh = (model.w @ d + back) * hs[t + 1] * (1 - hs[t + 1])
                g["wx"] += np.outer(x[t], dh)
                g["wh"] += np.outer(hs[t], dh)
                g["bh"] += dh
                back = model.wh @ dh
            for k, v in g.items():
                setattr(model, k, getattr(model, k) - rate * (v / len(x) + l2 * getattr(model, k)))
        losses.append(total / sum(len(x) for x, _ in sequences))
        if losses[-1] < best - 1e-6:
            best, since = losses[-1], 0
        else:
            since += 1
            rate *= decay if since > decay_after else 1.0
        if since > patience or rate < least_rate:
            break
    return losses


def emissions(sequences: DataFrame, model, key: list[str], features: str = "features") -> DataFrame:
    """``sequences(key, features: array of input arrays)`` with ``emissions`` (array of softmax arrays)."""
    shared = sequences.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            out = [run_network(shared.value, np.array(rows, float)).tolist() if rows else [] for rows in batch.column(len(key)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array(out, pa.list_(pa.list_(pa.float64())))], names=[*key, "emissions"])

    kinds = dict(sequences.dtypes)
    return sequences.select(*key, features).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", emissions array<array<double>>")


def fit_timing_classifier(df: DataFrame, columns: tuple[str, ...] = ("d0", "d1", "d2"), label: str = "label"):
    """Scaled, class-balanced logistic regression on a word's times. Returns (scaler model, classifier model)."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(n.values())
    weight = F.coalesce(*(F.when(F.col(label) == k, F.lit(total / (len(n) * c))) for k, c in n.items()))
    rows = VectorAssembler(inputCols=list(columns), outputCol="raw").transform(df.withColumn("weight", weight))
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(rows)
    model = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight").fit(scaler.transform(rows))
    return scaler, model


def word_vectors(sentences: DataFrame, column: str = "tokens", size: int = 50, min_count: int = 2, seed: int = 1, task_words: int = 1_000_000) -> DataFrame:
    """(word, vector) trained on token arrays. Up to ``task_words`` words are read in one sequence; more are dealt over as many tasks as that takes, whose vectors are averaged. Training reads the sentences twice, so they are written out."""
    kept = materialised(sentences.select(column), "sentences")
    n_words = kept.agg(F.sum(F.greatest(F.size(column), F.lit(0)))).first()[0] or 0
    return Word2Vec(inputCol=column, outputCol="v", vectorSize=size, minCount=min_count, seed=seed, numPartitions=max(1, -(-n_words // task_words))).fit(kept).getVectors()


def embedding_matrix(vocabulary: list[str], vectors: dict[str, np.ndarray], size: int = 50, seed: int = 0) -> np.ndarray:
    """Rows by vocabulary index; words without a vector are drawn from U(-0.2, 0.2)."""
    r = np.random.default_rng(seed)
    return np.array([vectors[w] if w in vectors else r.uniform(-0.2, 0.2, size) for w in vocabulary])


def most_frequent_tagger(tagged: DataFrame) -> DataFrame:
    """(word, pos): each word's most frequent tag, the alphabetically first on ties."""
    n = tagged.groupBy("word", "pos").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("word").agg(F.min_by("pos", F.struct(-F.col("n"), "pos")).alias("pos"))
