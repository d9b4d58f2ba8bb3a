"""Whitening of embeddings by eigenvectors that contour integration (FEAST, Polizzi 2009) finds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, staged

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Points of the quadrature on the upper half circle; eigenvalues of one interval, its rounds, and rounds after which its space grows.
POINTS, WIDTH, ROUNDS, PATIENCE = 8, 18, 60, 8
#: Entries are held to this size after scaling: beyond it a double has no fraction to floor.
LARGEST = 2.0**53
_LOW_BITS = 2.0**26


# -- the eigenproblem of one covariance matrix ---------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix similar to the symmetric v, by Householder reflections."""
    a = v.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += math.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed shift: the positive pivots of the shifted matrix, which Sylvester's law of inertia says."""
    least = np.finfo(float).tiny * max(1.0, float(np.square(off).max(initial=0.0)))
    found, pivot = 0, 1.0
    for k, d in enumerate(diagonal):
        pivot = d - shift - (off[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < least:
            pivot = -least
        found += pivot > 0
    return found


def eigenvalue(diagonal: np.ndarray, off: np.ndarray, k: int, low: float, high: float) -> float:
    """The k-th largest eigenvalue, known to lie in [low, high], by bisection on the counts."""
    while high - low > 4 * np.finfo(float).eps * max(abs(low), abs(high)):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if count_above(diagonal, off, middle) >= k else (low, middle)
    return (low + high) / 2


def _quadrature() -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors to the points on the upper half circle, by Gauss-Legendre, and their weights."""
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    return np.exp(1j * np.pi / 2 * (nodes + 1)), weights / 2


def response(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """What the quadrature of the circle on (low, high) makes of a part with such an eigenvalue: about 1 inside, 1/2 at the edge, falling outside."""
    turns, weights = _quadrature()
    radius = (high - low) / 2
    away = (low + high) / 2 + radius * turns[:, None] - np.asarray(values, float)
    return np.abs((weights[:, None] * (radius * turns[:, None] / away).real).sum(axis=0))


def space_size(n: int, count: int) -> int:
    return min(n, max(count + 6, math.ceil(1.5 * count)))


def rate(inside: list[float], outside: list[float], low: float, high: float, n: int) -> float:
    """The factor by which a round of feast lessens the error at least: the largest response that has no place in its space, over the least one inside."""
    spare = space_size(n, len(inside)) - len(inside)
    beyond = np.sort(response(np.array(outside), low, high))[::-1][spare:]
    return max(float(beyond.max(initial=0.0)) / float(response(np.array(inside), low, high).min()), float(np.finfo(float).eps))


def intervals(diagonal: np.ndarray, off: np.ndarray, wanted: int, floor: float) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals that hold the ``wanted`` largest eigenvalues above floor, and what lies as near below them as the cut asks for.

    Of up to WIDTH values, an interval takes those of which most settle in a round: a wide circle around few large values
    would not tell those at its lower edge from what lies below. Values equal to rounding stay together.
    """
    n = len(diagonal)
    reach = np.abs(np.concatenate(([0.0], off))) + np.abs(np.concatenate((off, [0.0])))
    bound = float((diagonal + reach).max(initial=floor)) * (1 + 1e-9)
    positive = count_above(diagonal, off, floor)
    values: list[float] = []

    def value(k: int) -> float:
        """The k-th largest eigenvalue, or floor."""
        while len(values) < min(k, positive):
            values.append(eigenvalue(diagonal, off, len(values) + 1, floor, bound))
        return values[k - 1] if k <= positive else floor

    def apart(k: int) -> int:
        """The first k from here on, after which there is a gap."""
        while k < positive and value(k) - value(k + 1) < max(1e-9 * value(k), floor):
            # All values within rounding of the next one follow at once; only the last is worked out.
            same = max(k + 1, min(positive, count_above(diagonal, off, value(k + 1) - max(1e-9 * value(k + 1), floor))))
            values.extend([value(k + 1)] * (same - 1 - len(values)))
            k = same
        return k

    found, above, high = [], 0, value(1) * 1.2
    while above < min(wanted, positive):
        last = min(positive, max(wanted, above) + 2 * WIDTH)
        value(last)
        best = None
        for k in sorted({apart(k) for k in range(above + 1, min(above + WIDTH, positive) + 1)}):
            low = (value(k) + value(k + 1)) / 2
            # Values below the last known one count as if they stood there.
            outside = values[:above] + values[k:] + [value(len(values) + 1 if len(values) < positive else positive + 1)] * (n - len(values))
            settled = -(k - above) * math.log(min(rate(values[above:k], outside, low, high, n), 1 - 1e-9))
            if best is None or settled > best[0]:
                best = settled, low, k
        _, low, k = best
        found.append((low, high, k - above))
        above, high = k, low
    return found


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high), of which there are ``count``, and their eigenvectors as columns.

    The spectral projector of the interval is a contour integral of (z - v)^-1 over the circle on it. Gauss-Legendre
    points on the upper half stand for it; a Rayleigh-Ritz step takes the vectors from the projected space; both repeat
    until the residuals are at rounding. Where values crowd at the edge, so that they don't settle, the space grows by half
    and so takes up those outside. More or fewer values than the count raise.
    """
    n, centre, radius = len(v), (low + high) / 2, (high - low) / 2
    random = np.random.default_rng([seed, n, count])
    space = random.standard_normal((n, space_size(n, count)))
    turns, weights = _quadrature()
    scale = np.linalg.norm(v, 2)
    before = math.inf
    for k in range(1, ROUNDS + 1):
        projected = np.zeros_like(space)
        for turn, weight in zip(turns, weights, strict=True):
            solved = np.linalg.solve((centre + radius * turn) * np.eye(n) - v, space.astype(complex))
            projected += weight * (radius * turn * solved).real
        q, _ = np.linalg.qr(projected)
        values, inner = np.linalg.eigh(q.T @ v @ q)
        space = q @ inner
        residual = np.linalg.norm(v @ space - space * values, axis=0)
        # A mixture of vectors from both sides may have its value inside, but not a small residual.
        settled = (values > low) & (values <= high) & (residual <= 4 * n * np.finfo(float).eps * scale)
        worst = residual[settled].max(initial=0.0)
        if settled.sum() == count and (worst >= before / 4 or k == ROUNDS):
            return values[settled], space[:, settled]
        before = worst if settled.sum() == count else math.inf
        if k % PATIENCE == 0 and settled.sum() != count:
            space = np.hstack([space, random.standard_normal((n, min(n, -(-3 * space.shape[1] // 2)) - space.shape[1]))])
    raise ArithmeticError(f"{settled.sum()} eigenvalues settled of the {count} that inertia counts")


def largest_components(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a covariance matrix, falling, and unit eigenvectors as rows.

    Only eigenvalues above rounding count: a direction without variance can't be whitened. A last Rayleigh-Ritz step
    over all intervals makes vectors of different ones orthogonal to rounding.
    """
    n, peak = len(v), float(np.abs(v).max(initial=0.0))
    if not peak:
        return np.zeros(0), np.zeros((0, n))
    v = v / peak
    diagonal, off = tridiagonal(v)
    floor = 8 * n * np.finfo(float).eps * np.linalg.norm(v, 2)
    parts = [feast(v, low, high, count, k)[1] for k, (low, high, count) in enumerate(intervals(diagonal, off, wanted, floor))]
    if not parts:
        return np.zeros(0), np.zeros((0, n))
    q, _ = np.linalg.qr(np.hstack(parts))
    values, inner = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-values)[:wanted]
    if count_above(diagonal, off, values[order[-1]] + floor) >= len(order):
        raise ArithmeticError("inertia counts a larger eigenvalue than those found")
    return values[order] * peak, (q @ inner[:, order]).T


# -- moments over the table ----------------------------------------------------------------------------------------

_MOMENTS = "dim int, n long, high array<long>, low array<long>, mean array<double>, scatter array<double>"
#: Shares that the tasks' moments merge in before the last step.
SHARES = 64


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)


def _arrow(names: str) -> pa.Schema:
    of = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(x.split(" ")[0], of[x.split(" ")[1]]) for x in names.split(", ")])


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims):
        part = batch.filter(pa.array(dims == dim))
        yield int(dim), part, np.asarray(part.column("y").flatten()).reshape(part.num_rows, int(dim))


def _merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and scatter about the mean of parts that have their own: all is centred before it is multiplied."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] / n * p[1] for p in parts)
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


def moments(rows: DataFrame, of: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """One row for each length of vectors in rows (dim, y): count, exact sums of y in two parts, mean and scatter of of(dim, y).

    A task returns one row for each length; these merge in two steps, so that no task reads them all.
    """
    schema = _arrow(_MOMENTS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for dim, _, y in _by_length(batch):
                m, high = of(dim, y), np.floor(y / _LOW_BITS)
                mean = m.mean(axis=0)
                one = len(m), mean, (m - mean).T @ (m - mean)
                sums = np.stack([high, y - high * _LOW_BITS]).astype(np.int64).sum(axis=1)
                held[dim] = (_merged([held[dim][0], one]), held[dim][1] + sums) if dim in held else (one, sums)
        yield _batch(schema, [(dim, n, *sums, mean, scatter.ravel()) for dim, ((n, mean, scatter), sums) in held.items()])

    def merge(table: pa.Table) -> pa.Table:
        parts, sums = [], 0
        for r in table.select(schema.names).to_pylist():
            k = len(r["mean"])
            parts.append((r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(k, k)))
            sums = sums + np.array([r["high"], r["low"]], np.int64)
        n, mean, scatter = _merged(parts)
        return pa.Table.from_batches([_batch(schema, [(r["dim"], n, *sums, mean, scatter.ravel())])])

    some = rows.mapInArrow(partial, _MOMENTS).withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    return some.groupBy("dim", "share").applyInArrow(merge, _MOMENTS).groupBy("dim").applyInArrow(merge, _MOMENTS)


_FIT = "dim int, n long, high array<long>, low array<long>, mean array<double>, values array<double>, vectors array<double>, trace double"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest components of each row of moments."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            k = len(r["mean"])
            v = np.array(r["scatter"]).reshape(k, k) / r["n"]
            values, vectors = largest_components((v + v.T) / 2)
            out.append((r["dim"], r["n"], r["high"], r["low"], r["mean"], values, vectors.ravel(), float(np.trace(v))))
        yield _batch(_arrow(_FIT), out)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, y array<double>): y is floor(64 * entry), the entry's long without the offset; vectors that are null or hold null or non-finite entries go."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    y = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))).cast("double"))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), y.alias("y"))


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of vectors (vec_id, embedding).

    Three passes: count, sums and covariance; the covariance of what whitening gives; the rows. Between them one row for
    each length of vectors reaches the driver (components and mean), whatever their number.

    Vectors of different lengths are fitted apart. Repeated rows of a vec_id, or rows without one, are vectors of their
    own. Directions without variance beyond rounding have no component, so equal vectors alone, or a single one, give no
    rows. Entries are held to 2^53 / 64. A deviation that a long can't hold is null. identity_error is the largest over
    all lengths. Other columns are left out; an empty table gives an empty result.
    """
    rows = staged(usable(vectors), "whitening-rows")
    fits = {}
    for r in moments(rows, lambda dim, y: y).mapInArrow(_solved, _FIT).collect():  # a row a length of vectors
        total = np.array([h * int(_LOW_BITS) + low for h, low in zip(r["high"], r["low"], strict=True)], object)
        values = np.array(r["values"][:components])
        axes = np.array(r["vectors"]).reshape(-1, r["dim"])[:components] if len(values) else np.zeros((0, r["dim"]))
        fits[r["dim"]] = r["n"], total, np.array([t / r["n"] for t in total], float), (axes / np.sqrt(values)[:, None]).T, values / (r["trace"] or 1.0)

    def of(dim: int, y: np.ndarray) -> np.ndarray:
        _, _, mean, axes, _ = fits[dim]
        return (y - mean) @ axes

    error = 0.0
    for r in moments(rows, of).select("n", "mean", "scatter").collect():  # a row a length
        k = len(r["mean"])
        error = max(error, float(np.abs(np.array(r["scatter"]).reshape(k, k) / r["n"] - np.eye(k)).max(initial=0.0)))

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                for dim, part, y in _by_length(whole.slice(at, 2048)):
                    n, total, _, axes, explained = fits[dim]
                    w, k = of(dim, y), axes.shape[1]
                    far = n * float(np.abs(y).max(initial=0.0)) + max((abs(float(t)) for t in total), default=0.0)
                    off = n * y.astype(np.int64 if far < 2**31 else object) - total.astype(np.int64 if far < 2**31 else object)
                    deviation = [d if d < 1 << 63 else None for d in map(int, np.square(off).astype(object).sum(axis=1))] if dim else [0] * len(y)
                    again = np.repeat(np.arange(len(y)), k)
                    columns = [part.column("vec_id").take(pa.array(again)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(y)), np.full(len(again), n), pa.array(deviation, pa.int64()).take(pa.array(again)), w.ravel(), np.tile(explained, len(y)), np.full(len(again), error)]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(told, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"))
