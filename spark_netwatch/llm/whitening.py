"""Operator 11, embedding whitening by mixed-precision refinement of eigenvectors.

Vectors become whole numbers (``floor(scale * entry)``); each distinct one counts once for the fit.
Sums and products are gathered in two passes over the distinct vectors: the sums first, then the
products of what is left after the nearest whole mean is taken off, so both are whole numbers and exact;
the rest of the mean is taken off the sums of products at the end. Tasks hand on one row per pair of
dimensions, which Spark adds up; the driver gets the ``d x d`` covariance, never a vector.

The covariance's eigenvectors are computed in float32 and corrected by Ogita-Aishima iterations: two
matrix products in higher precision (``numpy.longdouble``) give the error against orthogonality and
against the diagonal, from which each column is corrected at quadratic convergence. Columns whose
eigenvalues are too close for that correction form clusters; the covariance is projected on each
cluster, that small problem is solved on its own scale, and the iteration goes on.

Defined results: a vector that is null or holds null or non-finite entries is dropped; a shorter
vector than the longest is continued with zeros; an empty vector is one of zeros; rows that repeat a
vector are all returned and count once in the fit; components without variance have a null ``whitened``
(there are no more components than dimensions, and none is measured by ``identity_error`` that has no
variance); a ``deviation`` over 64 bits is the largest long; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE = 256
COMPONENTS = 4
#: Sums of products travel as high * 2**_SPLIT + low, each a double that is exact up to 2**53.
_SPLIT = 40
_LONG = np.iinfo(np.int64)


def eigenvectors(a: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the symmetric ``a``, in ``numpy.longdouble``."""
    a = np.asarray(a, np.longdouble)
    d = len(a)
    scale = np.max(np.abs(a)) if d else 0
    if not scale:
        return np.zeros(d, np.longdouble), np.eye(d, dtype=np.longdouble)
    a = a / scale
    _, start = np.linalg.eigh(a.astype(np.float32))
    x = start.astype(np.longdouble)
    least = np.finfo(np.longdouble).eps * d
    before = np.inf
    for _ in range(rounds):
        x, values, change = _corrected(a, x)
        if change <= least or change >= before and change < 1e-15:
            break
        before = change
        x = _clusters_solved(a, x, values, change)
    for _ in range(2):              # within a cluster the last turn is exact to first order only: make the columns orthogonal again
        x = x + x @ (np.eye(d) - x.T @ x) / 2
    order = np.argsort(-values)
    x = x[:, order] / np.sqrt(np.sum(x[:, order] ** 2, axis=0))
    return values[order] * scale, x


def _corrected(a: np.ndarray, x: np.ndarray):
    """One Ogita-Aishima step: corrected columns, their eigenvalues, size of the correction."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2     # else rounding, over a small gap, spoils the orthogonality
    values = np.diag(s) / (1 - np.diag(r))
    gap = values[None, :] - values[:, None]
    off = s - np.diag(values)
    near = np.abs(gap) <= 2 * (_norm(off) + _norm(a) * _norm(r))
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    return x + x @ e, values, max(np.max(np.abs(e)), np.max(np.abs(np.where(near, off - np.diag(np.diag(off)), 0))))


def _norm(m: np.ndarray):
    return np.sqrt(np.sum(m * m))


def _clusters_solved(a: np.ndarray, x: np.ndarray, values: np.ndarray, change) -> np.ndarray:
    """Turn the columns of each cluster of close eigenvalues so that they are the projected problem's eigenvectors."""
    order = np.argsort(values)
    close = np.diff(values[order]) <= max(change, np.finfo(np.float32).eps)
    x, k = x.copy(), 0
    while k < len(order):
        end = k
        while end < len(close) and close[end]:
            end += 1
        if end > k:
            columns = order[k:end + 1]
            middle = np.mean(values[columns])
            part = x[:, columns]
            small = part.T @ (a @ part - middle * part)
            small = (small + small.T) / 2
            size = np.max(np.abs(small))
            if size > 0:
                _, turn = np.linalg.eigh((small / size).astype(np.float64))
                x[:, columns] = part @ turn.astype(a.dtype)
        k = end + 1
    return x


@dataclass
class Whitening:
    """A fitted whitening: what a row needs to be projected."""
    n: int
    dims: int
    sums: list[int]                 # per dimension, over the distinct vectors
    components: np.ndarray          # dims x k, double
    values: np.ndarray              # k eigenvalues
    explained: np.ndarray           # k shares of the trace
    identity_error: float | None


def whole(vector: Column, scale: int = SCALE) -> Column:
    """Entries as whole numbers."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def whole_vectors(rows: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, x: the rows whose vector is whole and finite."""
    def bad(c):
        c = c.cast("double")
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    v = F.col(column)
    return rows.filter(v.isNotNull() & ~F.exists(v, bad)).select("vec_id", whole(v, scale).alias("x"))


def _matrix(column, dims: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of ``dims`` whole numbers; shorter ones go on with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if np.all(lengths == dims):
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return out


def _exact(m: np.ndarray, most: int) -> np.ndarray:
    """``m`` as it is if results up to ``most`` fit 64 bits, else as Python's whole numbers."""
    return m if most < 2 ** 62 else m.astype(object)


def _largest(m: np.ndarray) -> int:
    return max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0


def _sums(vectors: DataFrame, dims: int, centre: list[int] | None) -> dict:
    """Per dimension (``centre`` None), or per pair of them after ``centre`` is taken off: exact sums."""
    def tasks(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            if not len(x):
                continue
            if centre is None:
                part = _exact(x, _largest(x) * len(x)).sum(axis=0).astype(object)
            else:
                y = _centred(x, centre)
                y = _exact(y, _largest(y) ** 2 * len(y))
                part = (y.T @ y)[np.triu_indices(dims)].astype(object)
            total = part if total is None else total + part
        if total is not None:
            high = [int(t) >> _SPLIT for t in total]
            low = [int(t) - (h << _SPLIT) for t, h in zip(total, high, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(high)), pa.int32()), pa.array(map(float, high), pa.float64()), pa.array(map(float, low), pa.float64())], ["k", "high", "low"])

    rows = vectors.select("x").mapInArrow(tasks, "k int, high double, low double").groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {r["k"]: (int(r["high"]) << _SPLIT) + int(r["low"]) for r in rows}      # one row per pair of dimensions


def _centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    return _exact(x, _largest(x) + max(map(abs, centre), default=0)) - np.array(centre, object if max(map(abs, centre), default=0) >= 2 ** 62 else np.int64)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on the distinct ``x`` of ``vectors``."""
    dims = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    distinct = written(vectors.select(padded.alias("x")).distinct(), "vectors")
    n = distinct.count()
    if not n or not dims:
        return Whitening(n, dims, [], np.zeros((dims, 0)), np.zeros(0), np.zeros(0), None)
    found = _sums(distinct, dims, None)
    sums = [found[k] for k in range(dims)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products = _sums(distinct, dims, centre)
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]       # sums after the centre is taken off
    covariance = np.zeros((dims, dims), np.longdouble)
    for k, (i, j) in enumerate(zip(*np.triu_indices(dims), strict=True)):
        exact = n * products[k] - rest[i] * rest[j]                     # n * n times the covariance
        covariance[i, j] = covariance[j, i] = _quotient(exact, n * n)
    values, vectors_ = eigenvectors(covariance)
    trace = np.trace(covariance)
    k = min(components, dims)
    values = np.where(values[:k] > trace * dims * np.finfo(float).eps, values[:k], 0)
    chosen = vectors_[:, :k] * np.where(vectors_[np.argmax(np.abs(vectors_[:, :k]), axis=0), range(k)] < 0, -1, 1)
    model = Whitening(n, dims, sums, chosen.astype(np.float64), values.astype(np.float64),
                      (values / trace if trace else np.zeros(k)).astype(np.float64), None)
    model.identity_error = _identity_error(distinct, model)
    return model


def _quotient(a: int, b: int) -> np.longdouble:
    """a / b, rounded once to what a longdouble holds."""
    whole_part, rest = divmod(a, b)
    return np.longdouble(whole_part) + np.longdouble(rest) / np.longdouble(b)


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """(x - mean) on the components, over the root of the eigenvalue; NaN where there is no variance."""
    centre = [(2 * s + model.n) // (2 * model.n) for s in model.sums]
    rest = np.array([(s - model.n * c) / model.n for s, c in zip(model.sums, centre, strict=True)])
    y = _centred(x, centre).astype(np.float64) - rest
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.values > 0, (y @ model.components) / np.sqrt(model.values), np.nan)


def _identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, measured over the fit list."""
    live = np.flatnonzero(model.values > 0)
    if not len(live):
        return None

    def sums(offset):
        def tasks(batches):
            for batch in batches:
                w = _projected(_matrix(batch.column("x"), model.dims), model)[:, live]
                part = (w.sum(axis=0) if offset is None else (w - offset).T @ (w - offset)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(part)), pa.int32()), pa.array(part)], ["k", "part"])
        rows = distinct.mapInArrow(tasks, "k int, part double").groupBy("k").agg(F.sum("part").alias("part")).collect()
        return np.array([r["part"] for r in sorted(rows, key=lambda r: r["k"])]) / model.n

    covariance = sums(sums(None)).reshape(len(live), len(live))
    return float(np.max(np.abs(covariance - np.eye(len(live)))))


def _deviations(x: np.ndarray, model: Whitening) -> np.ndarray:
    centre = [(2 * s + model.n) // (2 * model.n) for s in model.sums]
    rest = [s - model.n * c for s, c in zip(model.sums, centre, strict=True)]
    y = _centred(x, centre)
    most = model.n * _largest(y) + max(map(abs, rest))
    y = _exact(y, most * most * model.dims)
    each = model.n * y - np.array(rest, object if most >= 2 ** 62 else np.int64)
    total = (each * each).sum(axis=1)
    return np.array([min(int(t), _LONG.max) for t in total], np.int64) if total.dtype == object else total


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    kind = vectors.schema["vec_id"].dataType
    k = len(model.values)

    def tasks(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), model.dims)
            if not len(x) or not k:
                continue
            rows = np.repeat(np.arange(len(x)), k)
            whitened = _projected(x, model).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), model.n)), pa.array(_deviations(x, model)[rows]), pa.array(whitened, from_pandas=True),
                pa.array(np.tile(model.explained, len(x))), pa.array([model.identity_error] * len(rows), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(tasks, f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Fit on all rows and project them."""
    vectors = whole_vectors(rows, column, scale)
    return transform(vectors, fit(vectors, components))
