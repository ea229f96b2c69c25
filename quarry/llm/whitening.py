"""Operator 11, embedding whitening: principal components by a randomised range finder.

Entries are put on a grid (x = floor(256 c), whole numbers); a vector that occurs more
than once counts once in the fit (the fit list). With V the covariance of the fit list:

1. A random block of ``COMPONENTS + OVERSAMPLE`` directions is orthonormalised to Q.
2. A pass over all centred rows gives Y = V Q: each task adds up its rows' products, so
   only matrices of dimension x directions leave tasks, and their sum the cluster.
3. Rayleigh-Ritz on Q and Y gives values and vectors with their residuals V u - e u. While
   these are too large, Y is orthonormalised and the pass repeated.
4. If the residuals don't get there within ``PASSES`` passes, or their pace shows that
   they won't, Q is expanded to the full dimension: one more pass, then exact.

Signs: the largest entry of a component (the first of equals) is positive. Of equal
eigenvalues any basis may come.

Rows whose vector is null, empty, or holds null or non-finite entries are left out, as
are those of another length than the most frequent one (the longer of equals). Directions
of no variance have no whitened values, so a fit list of one vector gives no rows, and an
empty table none. Repeated rows and ids give a row each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.storage import forget, materialise

GRID, COMPONENTS = 256, 4
OVERSAMPLE, PASSES, TOLERANCE = 8, 10, 1e-12
#: Entries of vectors that a task holds as a matrix at a time.
ENTRIES = 1 << 20


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: all of it bounded by the dimension."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray  # dimension x components
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int
    full: bool


def on_grid(rows: DataFrame, column: str = "embedding", keep: str = "vec_id") -> DataFrame:
    """``keep`` and x (array of long) of the rows that have a whole, finite vector of the most frequent length."""
    c = F.col(f"`{column}`").cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    sound = rows.where(c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, bad)).select(F.col(f"`{keep}`").alias(keep), F.transform(c, lambda v: F.floor(v * GRID)).alias("x"))
    lengths = sound.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("m"))
    first = lengths.orderBy(F.desc("m"), F.desc("d")).first()
    return sound.where(F.size("x") == (first["d"] if first else 0))


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, ENTRIES // d)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


def _summed(fit: DataFrame, product, shape: tuple[int, int], d: int) -> np.ndarray:
    """Sum of ``product(rows)``, a matrix of ``shape``, over all rows of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _matrices(batches, d):
            total += product(x.astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "v"])

    found = fit.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape[0] * shape[1])
    for r in found:
        out[r["cell"]] = r["v"]
    return out.reshape(shape)


def fit(grid: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE) -> Whitening | None:
    """Principal components of the distinct vectors of ``grid`` (x); None where there is no row."""
    listed = materialise(grid.select("x").distinct(), "fit-list")
    sums = listed.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    if not sums:
        return None
    d, n = len(sums), sums[0]["n"]
    total = [0] * d
    for r in sums:
        total[r["i"]] = int(r["s"])
    mean = np.array([s / n for s in total])
    trace = _summed(listed, lambda x: ((x - mean) ** 2).sum(keepdims=True).reshape(1, 1), (1, 1), d)[0, 0] / n

    def image(q: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return _summed(listed, product, q.shape, d) / n

    width, done, before = min(d, components + oversample), 0, None
    q = np.linalg.qr(np.random.Generator(np.random.PCG64(11)).standard_normal((d, width)))[0]
    while True:
        y = image(q)
        done += 1
        values, vectors, off = _ritz(q, y, components)
        good = off <= tolerance * max(values[0], 0.0)
        if good or q.shape[1] == d:
            break
        slow = done >= passes or done >= 3 and off * (off / before) ** (passes - done) > tolerance * values[0]
        before = off
        q = np.eye(d) if slow else np.linalg.qr(y)[0]
    some = values > max(trace, 0.0) * 1e-13
    values, vectors = values[some], vectors[:, some]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    vectors = vectors * np.where(sign == 0, 1, sign)
    scaled = vectors / np.sqrt(values)

    def product(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scaled
        return w.T @ w

    error = np.abs(_summed(listed, product, (len(values),) * 2, d) / n - np.eye(len(values))).max() if len(values) else 0.0
    forget(listed.sparkSession, listed)
    return Whitening(n, tuple(total), vectors, values, float(trace), float(error), done, q.shape[1] == d)


def _ritz(q: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` largest Ritz values and vectors of V on the span of q, with y = V q, and the largest residual."""
    small = q.T @ y
    e, w = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-e, kind="stable")[:k]
    e, w = e[order], w[:, order]
    u = q @ w
    return e, u / np.linalg.norm(u, axis=0), float(np.linalg.norm(y @ w - u * e, axis=0).max())


def whiten(grid: DataFrame, model: Whitening, keep: str = "vec_id") -> DataFrame:
    """``keep``, component, n, deviation, whitened, explained, identity_error of every row of ``grid`` and component.

    deviation is exact, and null where a long can't hold it.
    """
    n, k, d = model.n, len(model.values), len(model.sums)
    mean, scaled, exact = np.array([s / n for s in model.sums]), model.vectors / np.sqrt(model.values), np.array(model.sums, object)
    most = max(map(abs, model.sums))
    explained = pa.array(model.values / model.trace) if k else pa.array([], pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, d):
            rows = part.num_rows
            if d * (n * int(np.abs(x).max()) + most) ** 2 < 1 << 63:
                deviation = pa.array(((n * x - exact.astype(np.int64)) ** 2).sum(axis=1))
            else:
                large = ((n * x.astype(object) - exact) ** 2).sum(axis=1)
                deviation = pa.array([v if v < 1 << 63 else None for v in large.tolist()], pa.int64())
            again = pa.array(np.repeat(np.arange(rows), k))
            turn = np.tile(np.arange(k), rows)
            w = (x - mean) @ scaled
            yield pa.RecordBatch.from_arrays(
                [part.column(keep).take(again), pa.array((turn + 1).astype(np.int32)), deviation.take(again), pa.array(w.ravel()), explained.take(pa.array(turn))],
                [keep, "component", "deviation", "whitened", "explained"],
            )

    kind = grid.schema[keep].dataType.simpleString()
    out = grid.select(keep, "x").mapInArrow(run, f"{keep} {kind}, component int, deviation long, whitened double, explained double")
    return out.select(keep, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(model.identity_error).alias("identity_error"))


def whiten_rows(rows: DataFrame, column: str = "embedding", keep: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Fit on the distinct vectors of ``rows`` and whiten every row."""
    grid = on_grid(rows, column, keep)
    model = fit(grid, components)
    if model is None or not len(model.values):
        kind = rows.schema[keep].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"{keep} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whiten(grid, model, keep)
