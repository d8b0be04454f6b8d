"""Embedding whitening by matrix-free block subspace iteration.

Vectors are put on a grid of whole numbers, so that sums are exact. The mean and
the principal axes come from the distinct vectors (the fit list); every vector
is then centred, projected on the axes and scaled to unit variance.

The covariance V is never formed. A pass of Spark over the fit list computes
Xᵀ(XQ) / n for a narrow block Q, X being the centred rows: each task adds up its
own rows and Spark adds the tasks' sums by cell, so the driver gets dim x width
numbers however many rows and tasks there are. QR makes the next block from what
a pass returns, and Rayleigh-Ritz takes the axes from the space of the blocks.

Plain iteration keeps the newest block alone and gains a factor of (k-th
eigenvalue / first one left out) a pass. Embeddings have flat spectra, where this
is next to nothing (0.96 at 50,000 rows of 64 dimensions: 800 passes), so
Rayleigh-Ritz here also keeps the earlier blocks, up to ``MOST_COLUMNS``; beyond
that it goes on from the best axes alone. The end is certified: one more pass
multiplies the axes themselves, and unless every residual ``|Vu - eu|`` is at
most ``TOLERANCE`` times the largest eigenvalue the iteration continues.

Edge cases: null vectors and vectors with null, NaN or infinite entries are left
out, empty ones too. The number of dimensions is that of the longest vector left;
shorter ones lack entries, and are left out as well. Repeated vectors count once
in the fit and each have their rows; null and repeated ids are kept as they are.
Axes without variance can't be scaled: there are as many components as the
distinct vectors span, so a single distinct vector, or an empty table, gives no
rows. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common

#: Steps of the grid in a unit, and what is added to make entries positive.
STEPS, OFFSET = 64, 1_000_000
#: Components asked for, and columns of a block for each of them.
COMPONENTS, OVERSAMPLING = 16, 2
#: Columns that Rayleigh-Ritz works on at most.
MOST_COLUMNS = 512
#: Largest residual of a certified component, as a part of the largest eigenvalue.
TOLERANCE = 1e-12
#: An eigenvalue at most this part of the largest one is no variance but rounding.
NO_VARIANCE = 1e-12
#: Passes after which it gives up and raises; none of the supplied data needs more than five.
MOST_PASSES = 400


class Model(NamedTuple):
    """What whitening needs: the fit list's size and sums, the axes as columns, their variances."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def whole(vector: Column) -> Column:
    """Whether a vector has entries and all of them are finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))


def gridded(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x): the whole vectors, each entry as floor(64 c) + 1,000,000."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS) + F.lit(OFFSET).cast("long"))
    return rows.where(whole(F.col(vector))).select(key, x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """A batch of vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def away(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly; beyond 63 bits as Python numbers."""
    near = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=np.int64)
    delta = x - near
    if n * (int(np.abs(delta).max(initial=0)) + 1) < 2**62:
        return n * delta - rest
    return n * delta.astype(object) - rest.astype(object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, rounded once."""
    return (away(x, n, sums) / n).astype(np.float64)


def summed(fit: DataFrame, work: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """The sum of ``work`` over all batches, by cell; each task sends its sum once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(total.size), pa.int64()), "value": pa.array(total.ravel())})

    cells = fit.select("x").mapInArrow(run, f"cell long, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    return [value for _, value in sorted(cells.collect())]  # dim x width cells, whatever the number of rows


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of a staged table of distinct vectors ``x`` of one length; None for no rows."""
    first = summed(fit, lambda x: np.concatenate([[len(x)], x.sum(0)]), "long")
    if not first:
        return None
    n, sums = first[0], first[1:]
    dim, passes = len(sums), 0
    width = min(dim, OVERSAMPLING * components)

    def times(block: np.ndarray) -> tuple[np.ndarray, float]:
        """V times a block, and the trace of V."""
        nonlocal passes
        passes += 1
        if passes > MOST_PASSES:
            raise RuntimeError(f"{components} components aren't certified after {MOST_PASSES} passes")

        def work(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return np.append(c.T @ (c @ block), np.square(c).sum())

        found = np.array(summed(fit, work, "double")) / n
        return found[:-1].reshape(dim, -1), float(found[-1])

    block = np.linalg.qr(np.random.default_rng(11).standard_normal((dim, width)))[0]
    space, image = np.empty((dim, 0)), np.empty((dim, 0))
    while True:
        product, trace = times(block)
        space, image = np.hstack([space, block]), np.hstack([image, product])
        small = space.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-values)[:width]
        values, axes, moved = values[best], space @ turns[:, best], image @ turns[:, best]
        k = min(components, int((values > NO_VARIANCE * max(trace, 0.0)).sum()))
        if k == 0:
            return Model(n, sums, axes[:, :0], values[:0], trace, 0.0, 0.0, passes)
        left = np.linalg.norm(moved - axes * values, axis=0)
        if space.shape[1] == dim or left[:k].max() <= TOLERANCE * values[0]:
            own = np.linalg.qr(axes[:, :k])[0]
            product, trace = times(own)
            small = own.T @ product
            exact, turn = np.linalg.eigh((small + small.T) / 2)
            exact, turn = exact[::-1], turn[:, ::-1]
            axes_k = own @ turn
            residual = np.linalg.norm(product @ turn - axes_k * exact, axis=0).max()
            if residual <= TOLERANCE * exact[0]:
                scaled = axes_k / np.sqrt(exact)
                error = np.abs(scaled.T @ (product @ turn) / np.sqrt(exact) - np.eye(k)).max()
                return Model(n, sums, axes_k, exact, trace, float(residual), float(error), passes)
        if space.shape[1] + width > MOST_COLUMNS or space.shape[1] == dim:
            space, image = axes, moved
        fresh = moved - axes * values
        for _ in range(2):  # twice, as once leaves what rounding added
            fresh = fresh - space @ (space.T @ fresh)
            fresh, size = np.linalg.qr(fresh)
        room = min(fresh.shape[1], dim - space.shape[1])
        block = fresh[:, np.argsort(-np.abs(np.diag(size)))[:room]] if room else np.linalg.qr(axes)[0]
        if not room:
            space, image = np.empty((dim, 0)), np.empty((dim, 0))


def train(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> Model | None:
    """The model of a table of vectors; None if no vector is whole."""
    whole_rows = gridded(rows, vector, key)
    dim = whole_rows.agg(F.max(F.size("x"))).first()[0]
    if not dim:
        return None
    fit, path = common.stage(whole_rows.where(F.size("x") == dim).select("x").distinct(), "fit")
    model = fitted(fit, components)
    common.unstage(rows.sparkSession, path)
    return model


def whiten(rows: DataFrame, model: Model | None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row for each whole vector and component: its coordinate of unit variance, and figures of the fit.

    ``deviation`` is the sum over dimensions of (n x - S)², exact; if it doesn't
    fit a long, it raises.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not model.variances.size:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, axes, variances = model.n, model.sums, model.axes, model.variances
    k, scale, part = variances.size, np.sqrt(variances), variances / model.trace
    error = model.identity_error

    def work(batch: pa.RecordBatch) -> dict:
        m = batch.num_rows
        off = away(matrix(batch.column(1)), n, sums) if m else np.empty((0, len(sums)), dtype=np.int64)
        big = m and (off.dtype == object or len(sums) * float(np.abs(off).max()) ** 2 >= 2.0**62)
        squares = (np.square(off.astype(object)) if big else np.square(off)).sum(1)
        found = ((off / n).astype(np.float64) @ axes) / scale
        return {
            key: batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
            "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
            "n": pa.array(np.full(m * k, n, dtype=np.int64)),
            "deviation": pa.array([int(s) for s in squares], pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
            "whitened": pa.array(found.ravel()),
            "explained": pa.array(np.tile(part, m)),
            "identity_error": pa.array(np.full(m * k, error)),
        }

    common.prepare(rows.sparkSession)
    return common.per_batch(gridded(rows, vector, key).where(F.size("x") == len(sums)), work, schema)
