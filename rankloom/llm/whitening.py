"""Whitening of embeddings by shifted CholeskyQR over the distinct vectors.

Entries are rounded down to 64ths and kept as whole numbers, so sums and deviations are
exact. The centred rows are never written: each pass makes them anew from the packed whole
numbers, solves them through the triangular factors found so far, and sums up the Gram
matrix of what comes out. The first matrix is shifted, so that its Cholesky factor exists
however badly conditioned the rows are; further passes make the rows orthogonal to rounding.
The product R of the factors has the rows' singular values, and its SVD gives the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import written

STEPS = 64
#: What is added to an entry's number of steps; whatever is centred is the same without.
OFFSET = 1_000_000
#: Entries beyond this many steps can't be told from their neighbours; they count as not finite.
MOST_STEPS = 2.0**53

#: Passes go on until the Gram matrix is the identity within this times the dimensions.
ORTHOGONAL = 1e-14
MOST_PASSES = 8
#: Directions whose standard deviation is below this part of the largest are no components.
LEAST_DEVIATION = 1e-13
ROWS = 4096
#: A packed vector's number of entries.
LENGTH = "CAST((octet_length(key) - 1) / conv(hex(substring(key, 1, 1)), 16, 10) AS INT)"


@dataclass(frozen=True)
class Moments:
    """Number of fitted vectors and the exact sum of their entries, in steps without the offset."""

    n: int
    sums: tuple[int, ...]


@dataclass(frozen=True)
class Whitening:
    """What was fitted: components as columns, by falling variance, in steps of a 64th."""

    moments: Moments
    components: np.ndarray
    variances: np.ndarray
    trace: float
    passes: int
    identity_error: float


def _steps(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Indices of the usable rows of a list column and their entries in whole steps."""
    numbers = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    with np.errstate(over="ignore", invalid="ignore"):
        steps = np.floor(numbers * STEPS)
        good = np.concatenate([[0], np.cumsum(np.abs(steps) < MOST_STEPS)])
    whole = (lengths > 0) & (good[ends[1:]] - good[ends[:-1]] == lengths)
    rows = np.flatnonzero(whole)
    return rows, [steps[ends[k] : ends[k + 1]].astype(np.int64) for k in rows]


def _packed(steps: np.ndarray) -> bytes:
    """A vector in the least whole-number type that holds it, the type's width first."""
    most = max(-int(steps.min()) - 1, int(steps.max()))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def _unpacked(key: bytes) -> np.ndarray:
    return np.frombuffer(key, f"<i{key[0]}", offset=1).astype(np.int64)


def packed(embeddings: DataFrame) -> DataFrame:
    """Rows ``(vec_id, key)`` of the usable vectors; equal keys are equal rounded vectors."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                kept, steps = _steps(part.column(1))
                keys = pa.array([_packed(s) for s in steps], pa.binary())
                yield pa.record_batch([part.column(0).take(pa.array(kept)), keys], ["vec_id", "key"])

    return rows.mapInArrow(pack, f"vec_id {kind}, key binary")


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """The vectors of a batch as matrices of whole steps."""
    for at in range(0, batch.num_rows, ROWS):
        keys = batch.column(column).slice(at, ROWS).to_pylist()
        if keys:
            yield np.stack([_unpacked(key) for key in keys])


def _deviations(steps: np.ndarray, moments: Moments) -> np.ndarray:
    """``n * x - S`` exactly, as 64-bit numbers if these hold it, else as Python's."""
    most = max(int(steps.max()), -int(steps.min()), 1) * moments.n + max(map(abs, moments.sums))
    kind = np.int64 if most < 2**62 else object
    return moments.n * steps.astype(kind) - np.array(moments.sums, kind)


def centred(steps: np.ndarray, moments: Moments) -> np.ndarray:
    """``x - S / n``; the difference is taken in whole numbers."""
    return (_deviations(steps, moments) / moments.n).astype(np.float64)


def exact_squares(steps: np.ndarray, moments: Moments) -> list[int | None]:
    """Of each vector the sum of ``(n * x - S) ** 2``; null where 64 bits can't hold it."""
    apart = _deviations(steps, moments)
    most = int(np.abs(apart).max())
    if most * most * apart.shape[1] < 2**63:
        return (apart.astype(np.int64) ** 2).sum(1).tolist()
    sums = (apart.astype(object) ** 2).sum(1).tolist()
    return [s if s < 2**63 else None for s in sums]


def solved(block: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``block`` times the inverse of the upper triangular ``r``, column by column."""
    out = np.empty_like(block)
    for j in range(r.shape[1]):
        out[:, j] = (block[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _moments(fit: DataFrame, width: int) -> Moments:
    """One pass of whole-number sums; a task sends one row for each dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            for block in _blocks(batch, 0):
                wide = int(np.abs(block).max()) * len(block) >= 2**62
                part = block.astype(object).sum(0) if wide else block.sum(0)
                total = [a + int(b) for a, b in zip(total, part)]
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array(map(str, total))], ["i", "part"])

    parts = fit.select("key").mapInArrow(sums, "i int, part string")
    rows = parts.groupBy("i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    total = {r.i: int(r.total) for r in rows}
    return Moments(fit.count(), tuple(total[i] for i in range(width)))


def gram(fit: DataFrame, width: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The Gram matrix of ``work(block)`` over all fitted vectors.

    A task sends its matrix row by row; the rows are added up by number, so what the
    driver gets is one matrix, whatever the number of vectors.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for block in _blocks(batch, 0):
                made = work(block)
                total += made.T @ made
        yield pa.record_batch(
            [pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "part"]
        )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[i] = total.get(i, 0.0) + np.array(part)
        if total:
            parts = pa.array(list(total.values()), pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(list(total), pa.int32()), parts], ["i", "part"])

    parts = fit.select("key").mapInArrow(partial, "i int, part array<double>")
    whole = parts.repartition("i").mapInArrow(added, "i int, part array<double>").collect()
    out = np.zeros((width, width))
    for i, row in whole:
        out[i] = row
    return (out + out.T) / 2


def cholesky(matrix: np.ndarray, rows: int) -> np.ndarray:
    """The upper factor of a Gram matrix; shifted above rounding if it isn't positive definite."""
    shift = 0.0
    size = max(float(np.trace(matrix)), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(matrix + shift * np.eye(len(matrix))).T
        except np.linalg.LinAlgError:
            shift = 10 * shift or len(matrix) * np.finfo(float).eps * size


def fit(keys: DataFrame, most: int | None = None) -> Whitening | None:
    """Fit on ``keys (key)``, each distinct vector once; None if no direction varies.

    Vectors of another length than ``fitted_length`` gives have to be left out before.
    ``most`` is the number of components that are wanted.
    """
    width = fitted_length(keys)
    if width is None:
        return None
    moments = _moments(keys, width)
    first = gram(keys, width, lambda block: centred(block, moments))
    trace = float(np.trace(first))
    if not trace > 0:
        return None
    # The shift of the first pass: above what rounding can take off an eigenvalue.
    eps = np.finfo(float).eps
    shift = 11 * (moments.n * width + width * (width + 1)) * eps / 2 * float(np.linalg.norm(first, 2))
    factors = [cholesky(first + shift * np.eye(width), moments.n)]
    passes = 1
    while True:

        def orthogonal(block: np.ndarray, factors: tuple = tuple(factors)) -> np.ndarray:
            made = centred(block, moments)
            for r in factors:
                made = solved(made, r)
            return made

        left = gram(keys, width, orthogonal)
        passes += 1
        # Directions in which the rows don't vary at all stay at zero and are set aside.
        values, vectors = np.linalg.eigh(left)
        off = np.abs(values[values > 0.5] - 1).max(initial=0.0)
        if passes > 2 and off <= ORTHOGONAL * width and not ((values > 1e-6) & (values <= 0.5)).any():
            break
        if passes == MOST_PASSES:
            break
        factors.append(cholesky(left, moments.n))
    r = factors[0]
    for factor in factors[1:]:
        r = factor @ r
    # What the last pass leaves, the identity to rounding, is put before R.
    r = (np.sqrt(np.maximum(values, 0))[:, None] * vectors.T) @ r
    _, deviations, components = np.linalg.svd(r)
    varied = deviations > LEAST_DEVIATION * deviations[0]
    components, deviations = components[varied][:most].T, deviations[varied][:most]
    signs = np.sign(components[np.abs(components).argmax(0), range(components.shape[1])])
    components, variances = components * signs, deviations**2 / moments.n
    scale = components / np.sqrt(variances)
    held = gram(keys, len(variances), lambda block: centred(block, moments) @ scale)
    worst = float(np.abs(held / moments.n - np.eye(len(variances))).max())
    return Whitening(moments, components, variances, trace / moments.n, passes, worst)


def fitted_length(keys: DataFrame) -> int | None:
    """The commonest length of the vectors, of several the greatest; None if there are none."""
    counts = keys.groupBy(F.expr(LENGTH).alias("length")).count()
    found = counts.orderBy(F.desc("count"), F.desc("length")).first()
    return found and found.length


def whitened(embeddings: DataFrame, most: int = 16) -> tuple[DataFrame, Whitening | None]:
    """Rows ``(vec_id, component, n, deviation, whitened, explained, identity_error)`` and what was fitted.

    ``embeddings`` needs ``vec_id`` and ``embedding``; other columns are not read. Rows are
    left out whose vector is null, empty, holds null or non-finite entries or such that
    are beyond ``MOST_STEPS``, or has another length than the commonest. Vectors that are
    equal after rounding are fitted once, and each row of theirs gets the same results;
    rows that repeat are returned again. Components are numbered from 1 by falling variance,
    up to ``most``, and their largest entry is positive; directions that don't vary are no
    components, so one distinct vector, or none, gives no rows. ``explained`` is a component's
    part of the variance; ``identity_error`` says how far the covariance of the whitened fitted
    vectors is from the identity, at its worst entry.
    """
    rows = packed(embeddings)
    distinct = written(rows.select("key").distinct(), "vectors")
    width = fitted_length(distinct)
    if width is not None:
        distinct, rows = (df.where(F.expr(LENGTH) == width) for df in (distinct, rows))
    model = fit(distinct, most)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    columns = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        empty = embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, {columns}")
        return empty, None
    names = ["vec_id", *(column.split()[0] for column in columns.split(", "))]
    count = len(model.variances)
    explained = model.variances / model.trace
    scale = model.components / np.sqrt(model.variances)
    moments = model.moments

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for block in _blocks(part, 1):
                    values = centred(block, moments) @ scale
                    of = np.repeat(np.arange(len(block)), count)
                    yield pa.record_batch(
                        [
                            part.column(0).take(pa.array(of)),
                            pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(block))),
                            pa.array(np.full(len(of), moments.n)),
                            pa.array(exact_squares(block, moments), pa.int64()).take(pa.array(of)),
                            pa.array(values.ravel()),
                            pa.array(np.tile(explained, len(block))),
                            pa.array(np.full(len(of), model.identity_error)),
                        ],
                        names,
                    )

    return rows.mapInArrow(project, f"vec_id {kind}, {columns}"), model
