"""Operator 11: whitening of vectors of whole numbers by a matrix-free block Lanczos iteration.

The covariance V of the fit list (every distinct vector once) is never formed. A pass over the fit list gives V times a block of vectors: each task centres its rows exactly in whole numbers, multiplies
``Y' (Y B)`` and sends a row a dimension, which Spark adds up. The iteration keeps a basis Q and V Q on the driver (as many numbers as dimensions times basis vectors, whatever the number of rows):

* every new block is orthogonalised twice against the whole basis and within itself;
* directions that vanish there (the basis spans an invariant subspace, as with equal or few distinct values) break the iteration down: it restarts with fresh random directions in their place, unless the basis is the whole space;
* a basis of ``BASIS`` blocks is restarted from its leading Ritz vectors;
* it ends when each wanted pair has a residual |V u - e u| of at most ``TOLERANCE`` of the largest e, or, where rounding allows no better, when residuals below ``NEAR`` have not fallen for ``BASIS`` passes.

The trace of V comes from the deviations: the sum over dimensions of (n x - S)^2, exact in whole numbers, summed over the fit list and divided by n^3. So the share that a component explains needs no further component.

Defined results: rows whose vector is null, or holds a null, NaN or infinite entry, are dropped; repeated rows each get their own result and count once in the fit; ids may be null or repeated; components whose
variance is no more than ``RANK`` of the largest one are no components, so a list of one distinct vector, or of empty vectors, gives no row, and neither does an empty table; equal variances (ties) have any orthonormal basis of
their space. Vectors of different lengths, and deviations beyond 64 bits, are errors. Other columns of any name do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialise, read_table

COMPONENTS = 16
#: Vectors added a pass, and blocks after which the basis is restarted.
BLOCK, BASIS = 16, 24
TOLERANCE, NEAR, RANK = 1e-14, 1e-10, 1e-12
PASSES = 1000
SEED = 11


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with sums ``sums``; unit ``vectors`` (dimensions x components) with falling ``variances``; the ``trace`` of the covariance; ``identity_error``: largest entry of the
    covariance of the whitened fit list minus the identity."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float


def is_finite(vector: Column) -> Column:
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector.cast("array<double>"), lambda c: F.coalesce(entry(c), F.lit(False)))


def on_grid(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """Whole numbers floor(scale * c) + shift of the entries."""
    return F.transform(vector.cast("array<double>"), lambda c: (F.floor(c * F.lit(float(scale))) + F.lit(shift)).cast("long"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as an array."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _offsets(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S, sum of its squares), exact."""
    off = n * x - sums
    square = (off.astype(float) ** 2).sum(axis=1)
    if square.size and square.max() > 2.0**62:
        raise ArithmeticError("deviations do not fit 64 bits")
    return off, (off * off).sum(axis=1)


def _summed(fit: DataFrame, of, width: int, kind: str = "double") -> np.ndarray:
    """Rows ``at`` of the array that ``of(x)`` gives for all vectors: a task adds up its own, Spark adds up the tasks, a row at a time."""
    schema = f"at int, s array<{kind}>"

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(total)), pa.int32()), "s": pa.array(list(total), pa.list_(pa.float64() if kind == "double" else pa.int64()))})

    parts = fit.mapInArrow(run, schema)
    rows = parts.groupBy("at").agg(*(F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(width))).orderBy("at").collect()
    return np.array([r[1:] for r in rows])


def _orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator, size: int) -> np.ndarray:
    """``block`` orthogonal to ``basis`` and within itself; directions of no more than rounding are replaced by random ones, as far as there is room."""
    out = basis
    room = min(size, basis.shape[0] - basis.shape[1])
    given, tries = 0, 0
    while out.shape[1] - basis.shape[1] < room and tries < 4 * size + 8:
        fresh = given >= block.shape[1]
        v = rng.standard_normal(basis.shape[0]) if fresh else block[:, given].copy()
        least = (1e-8 if fresh else 1e-13) * (np.linalg.norm(v) if fresh else scale)
        given, tries = given + 1, tries + fresh
        for _ in range(3):
            v -= out @ (out.T @ v)
        norm = np.linalg.norm(v)
        if norm <= least:
            continue
        v /= norm
        v -= out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, basis.shape[1] :]


def block_lanczos(times, dimensions: int, wanted: int, size: int = BLOCK, most: int = BASIS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, unit eigenvectors, passes) of the ``wanted`` largest eigenvalues of a symmetric operator given as ``times(block)``."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, dimensions)
    size = min(max(size, wanted), dimensions)  # an eigenvalue shows no more copies than the block has vectors
    basis, images = np.empty((dimensions, 0)), np.empty((dimensions, 0))
    block = _orthonormal(np.empty((dimensions, 0)), basis, 0.0, rng, size)
    best, best_pass = np.inf, 0
    for passes in range(1, PASSES + 1):
        basis, images = np.column_stack([basis, block]), np.column_stack([images, times(block)])
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        top = max(abs(values[0]), abs(values[-1]))
        u = basis @ vectors[:, :wanted]
        residuals = np.linalg.norm(images @ vectors[:, :wanted] - u * values[:wanted], axis=0)
        worst = residuals.max() / top if top > 0 else 0.0
        if worst < 0.9 * best:
            best, best_pass = worst, passes
        if basis.shape[1] >= dimensions or (basis.shape[1] >= wanted and (worst <= TOLERANCE or (worst < NEAR and passes - best_pass >= most))):
            return values[:wanted], u, passes
        # what the operator adds to the whole basis; the residuals of all Ritz vectors lie in it, so it goes on from the leading ones after a restart
        last = images[:, -block.shape[1] :]
        step = last - basis @ (basis.T @ last)
        step -= basis @ (basis.T @ step)
        if basis.shape[1] + size > max(most * size, 2 * wanted + size):
            keep = vectors[:, : wanted + size]
            basis, images = basis @ keep, images @ keep
        block = _orthonormal(step, basis, top, rng, size)
        if not block.shape[1]:
            return values[:wanted], u, passes
    raise ArithmeticError(f"no convergence in {PASSES} passes")


def fit_whitening(vectors: DataFrame, column: str, components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """Fits on the distinct vectors of whole numbers (array<long>) of ``column``; None if there are none."""
    fit = materialise(vectors.select(F.col(column).alias("x")).distinct())
    n, shortest, longest = fit.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return None
    if shortest != longest:
        raise ValueError(f"vectors of {shortest} and of {longest} entries")
    if not longest:
        return Whitening(n, np.empty(0, np.int64), np.empty((0, 0)), np.empty(0), 0.0, 0.0)
    sums = _summed(fit, lambda x: x.sum(axis=0)[:, None], 1, "long")[:, 0].astype(np.int64)
    deviations = fit.mapInArrow(_deviations(n, sums), "s decimal(38,0)").agg(F.sum("s")).first()[0]
    trace = float(deviations) / float(n) ** 3

    def times(b: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            y = _offsets(x, n, sums)[0] / n
            return y.T @ (y @ b)

        return _summed(fit, of, b.shape[1]) / n

    values, u, _ = block_lanczos(times, longest, components, block)
    real = values > RANK * values[0] if values[0] > 0 else np.zeros(len(values), bool)
    values, u = values[real], u[:, real]
    error = 0.0
    if values.size:
        scaled = u / np.sqrt(values)
        whitened = lambda x: (_offsets(x, n, sums)[0] / n) @ scaled
        mean = _summed(fit, lambda x: whitened(x).sum(axis=0)[:, None], 1)[:, 0] / n

        def square(x: np.ndarray) -> np.ndarray:
            z = whitened(x) - mean
            return z.T @ z

        error = float(np.abs(_summed(fit, square, values.size) / n - np.eye(values.size)).max())
    return Whitening(n, sums, u, values, trace, error)


def _deviations(n: int, sums: np.ndarray):
    def run(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                total += sum(_offsets(_matrix(batch.column(0)), n, sums)[1].tolist())
        yield pa.RecordBatch.from_pydict({"s": pa.array([total], pa.decimal128(38, 0))})

    return run


def whiten(rows: DataFrame, column: str, model: Whitening) -> DataFrame:
    """All columns of ``rows``, then ``deviation`` and ``whitened`` (array<double>, an entry a component) of the vectors of whole numbers in ``column``; underscores before names that are taken."""
    deviation = free_name("deviation", rows.columns)
    whitened = free_name("whitened", rows.columns)
    at = rows.columns.index(column)
    scaled = model.vectors / np.sqrt(model.variances)
    n, sums = model.n, model.sums

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                off, square = _offsets(_matrix(batch.column(at)), n, sums)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(square), pa.array(list((off / n) @ scaled), pa.list_(pa.float64()))], names=[*batch.schema.names, deviation, whitened])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(deviation, T.LongType()), T.StructField(whitened, T.ArrayType(T.DoubleType()))]))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    rows = table.filter(is_finite(F.col("embedding"))).select("vec_id", on_grid(F.col("embedding")).alias("x"))
    model = fit_whitening(rows, "x")
    if model is None or not model.variances.size:
        rows, model = rows.limit(0), Whitening(0, np.empty(0, np.int64), np.empty((0, 0)), np.empty(0), 0.0, 0.0)
    done = whiten(rows, "x", model)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.variances)).cast("array<double>")
    return done.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(model.identity_error).alias("identity_error")
    )
