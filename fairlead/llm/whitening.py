"""Whitening by leading eigenvectors of a covariance, found by Chebyshev-filtered subspace iteration.

The fit list is every distinct vector of whole numbers once. A pass over it multiplies the covariance with a block of columns:
each task subtracts the exact mean from its rows, ``C``, and adds up ``Cᵀ(CQ)``; only that small matrix leaves the task. One filter of
degree ``DEGREE`` is as many passes: the Chebyshev recurrence damps what lies between 0 and the smallest Ritz value of the block
and lets the rest grow. The block is made orthonormal (QR), one more pass gives the Rayleigh-Ritz problem, and the residual norms
of the wanted pairs say when to stop. The mean is ``S / n`` with whole ``S`` and ``n``, so rows are ``(n * x - S) / n``, rounded once,
however far the vectors lie from zero.

Rows whose vector is null or holds a null or non-finite entry are left out; null and repeated ids stay, one result for each row.
Vectors of several lengths are compared as if padded with the step of zero. Components without variance (eigenvalue below
``FLAT`` of the largest) do not exist, so there are fewer than asked for where vectors span less, and none for a single distinct
vector or an empty table. Equal eigenvalues leave the choice of their vectors open; the start block is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import cut_lineage

#: Passes of a filter, extra columns of the block, rounds at most, rows multiplied at once.
DEGREE, EXTRA, ROUNDS, ROWS = 8, 32, 60, 4096
#: Entries of the fit list in a task of a pass, and sums of tasks that the driver adds up; more are added up by tasks first.
ENTRIES, GATHERED = 1 << 19, 64
#: Residual norms wanted, those accepted where rounding allows no better, and eigenvalues that count as none, as shares of the largest eigenvalue.
SURE, ENOUGH, FLAT = 2e-15, 1e-12, 1e-12


class NotCertified(RuntimeError):
    """The residuals stayed above ``ENOUGH``."""


def whole_steps(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of each entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite entries."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c)), F.lit(False))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column, all of ``width`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def _row(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])


@dataclass
class Spread:
    """Distinct vectors (``x array<long>``), their number, their sums, and what a pass needs."""

    fit: DataFrame
    n: int
    sums: np.ndarray
    tasks: int

    def totals(self, columns: int, body) -> np.ndarray:
        """Sums over all rows of what ``body`` makes of centred rows, ``columns`` numbers a task."""
        n, sums = self.n, self.sums

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(columns)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    x = _rows(batch.column(0).slice(at, ROWS), len(sums))
                    total += body((n * x - sums) / n).ravel()
            yield _row(total)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _row(sum((np.frombuffer(part.as_py()) for batch in batches for part in batch.column(0)), np.zeros(columns)))

        parts, tasks = self.fit.mapInArrow(task, "part binary"), self.tasks
        while tasks > GATHERED:
            tasks = int(np.ceil(np.sqrt(tasks)))
            parts = parts.repartition(tasks).mapInArrow(add, "part binary")
        return sum((np.frombuffer(r["part"]) for r in parts.collect()), np.zeros(columns))

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times ``q``, one pass."""
        return self.totals(q.size, lambda c: c.T @ (c @ q)).reshape(q.shape) / self.n

    def trace(self) -> float:
        return float(self.totals(len(self.sums), lambda c: (c * c).sum(0)).sum() / self.n)


def spread_of(vectors: DataFrame) -> Spread | None:
    """The fit list of ``vectors (x array<long>)``, written once; None without rows."""
    width = vectors.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    fit = cut_lineage(vectors.select("x").distinct())
    added = fit.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)]).first()
    tasks = min(fit.rdd.getNumPartitions(), -(-added["n"] * width // ENTRIES))
    return Spread(fit.coalesce(tasks), added["n"], np.array(added[1:], np.int64), tasks)


def _filtered(spread: Spread, q: np.ndarray, low: float, high: float) -> np.ndarray:
    """A Chebyshev polynomial of the covariance times ``q``: small for eigenvalues from 0 to ``low``, about one at ``high``."""
    half = low / 2
    shrink = half / (high - half)
    first = shrink
    before, now = q, (spread.times(q) - half * q) * (shrink / half)
    for _ in range(DEGREE - 1):
        following = 1 / (2 / first - shrink)
        before, now = now, (spread.times(now) - half * now) * (2 * following / half) - shrink * following * before
        shrink = following
    return now


def leading(spread: Spread, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors as columns, and the largest residual norm as a share of the largest eigenvalue."""
    width = len(spread.sums)
    wanted, block = min(components, width), min(components + EXTRA, width)
    q = np.linalg.qr(np.random.default_rng(7).normal(size=(width, block)))[0]
    best = (np.inf, None, None)
    worse = 0
    for _ in range(ROUNDS):
        product = spread.times(q)
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        top = values[0]
        if top <= 0:
            return np.zeros(0), np.zeros((width, 0)), 0.0
        real = int((values[:wanted] > FLAT * top).sum())
        residual = float(np.linalg.norm(product[:, :real] - q[:, :real] * values[:real], axis=0).max() / top)
        if residual < best[0] / 2:
            worse = 0
        else:
            worse += residual < ENOUGH or block == width  # no better: rounding
        if residual < best[0]:
            best = (residual, values[:real].copy(), q[:, :real].copy())
        if best[0] <= SURE or worse >= 1:
            break
        low = max(values[-1], FLAT * top)
        q = np.linalg.qr(_filtered(spread, q, low, top) if low < top else product)[0]
    if best[0] > ENOUGH:
        raise NotCertified(f"residual {best[0]:.1e} of the largest eigenvalue after {ROUNDS} rounds")
    return best[1], best[2], best[0]


@dataclass
class Whitening:
    """What a fit found: number and sums of the fit list, eigenvalues, eigenvectors as columns, trace, largest residual (as a share)."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float
    residual: float
    identity_error: float


def fit(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """Fits on the distinct ``x`` of ``vectors``; None without rows. The driver holds matrices of width times block."""
    spread = spread_of(vectors)
    if spread is None:
        return None
    values, axes, residual = leading(spread, components)
    k = len(values)
    error = 0.0
    if k:
        scaled = axes / np.sqrt(values)
        middle = spread.totals(k, lambda c: (c @ scaled).sum(0)) / spread.n

        def around(c: np.ndarray) -> np.ndarray:
            w = c @ scaled - middle
            return w.T @ w

        error = float(np.abs(spread.totals(k * k, around).reshape(k, k) / spread.n - np.eye(k)).max())
    return Whitening(spread.n, spread.sums, values, axes, spread.trace(), residual, error)


def padded(vectors: DataFrame, column: str, filler: int) -> DataFrame:
    """``column`` (array<long>) filled up to the length of the longest with ``filler``."""
    width = vectors.agg(F.max(F.size(column)), F.min(F.size(column))).first()
    if width[0] is None or width[0] == width[1]:
        return vectors
    return vectors.withColumn(column, F.concat(column, F.array_repeat(F.lit(filler).cast("long"), F.lit(width[0]) - F.size(column))))


def whiten(vectors: DataFrame, model: Whitening, column: str = "x") -> DataFrame:
    """``vectors`` with ``deviation long`` (sum of (n * x - S) squared, exact, an error where it passes a long) and ``whitened array<double>``.

    Map-only; columns of these names are replaced.
    """
    kept = [f for f in vectors.schema.fields if f.name != "whitened"]
    at = [f.name for f in kept].index(column)
    n, sums, scaled = model.n, model.sums, model.axes / np.sqrt(model.values)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = ((n * _rows(batch.column(at), len(sums)) - sums) / n) @ scaled
            ends = np.arange(len(w) + 1, dtype=np.int32) * scaled.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))], names=[*[f.name for f in kept], "whitened"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "whitened array<double>"])
    out = vectors.select(*[vectors[f.name] for f in kept]).mapInArrow(body, schema)
    apart = F.zip_with(F.col(column), F.lit(sums.tolist()), lambda x, s: F.lit(n).cast("long") * x - s.cast("long"))
    return out.withColumn("deviation", F.aggregate(apart, F.lit(0).cast("long"), lambda a, d: a + d * d))
