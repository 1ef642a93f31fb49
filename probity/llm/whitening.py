"""Embedding whitening on the leading principal components, found by Jacobi-Davidson.

The covariance is never formed: a product with a block of vectors is one distributed pass
over the distinct vectors, V Q = sum y (y Q) / n with y = x - mean, summed from one partial
result a task.  The eigensolver keeps an orthonormal basis on the driver (dimension x a few
times the number of components), takes Ritz pairs of it, and widens it by solutions of the
projected correction equations

    (I - QQ') (V - theta I) (I - QQ') t = -r,    t orthogonal to Q,

which MINRES solves for all open pairs at once, one joint product a step.  Pairs whose
residual is at double precision are locked: they stay in the basis and get no more
corrections.  It ends when all are locked, or when residuals that are already at rounding
level stop falling.

Vectors are whole numbers, so counts, sums and deviations are exact; ``quantised`` makes
them from real embeddings.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.common import materialise

COMPONENTS = 16
GUARD = 8  # Ritz vectors beyond the wanted ones that corrections are kept orthogonal to
INNER_STEPS = 24
INNER_REDUCTION = 0.01
OUTER_STEPS = 200
_PACK = 2_048  # vectors in one packed row
_DIRECT = 64 << 20  # bytes of partial sums that the driver adds up by itself
_LARGEST = float(1 << 52)


def quantised(vec: Column, scale: float = 64.0, offset: int = 1_000_000) -> Column:
    """floor(scale * c) + offset for each entry, as array<bigint>; null where the vector is null or holds a null or non-finite entry.

    Scaled entries beyond +-2**52 count as +-2**52.
    """
    wide = vec.cast("array<double>")
    bad = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))
    whole = F.transform(wide, lambda c: F.floor(F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), c * F.lit(float(scale))))) + F.lit(offset).cast("long"))
    return F.when(~bad, whole)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _pack(batches, d):
    for batch in batches:
        x = _matrix(batch.column(0), d)
        for at in range(0, len(x), _PACK):
            yield pa.RecordBatch.from_arrays([pa.array([x[at:at + _PACK].tobytes()], pa.binary())], names=["pack"])


def _packs(batches, d):
    for batch in batches:
        for blob in batch.column(0):
            yield np.frombuffer(blob.as_buffer(), dtype=np.int64).reshape(-1, d)


@dataclass
class Centre:
    """Exact count and sums; ``of`` subtracts the mean without losing digits to a large offset."""

    n: int
    sums: list[int]

    def __post_init__(self):
        whole = [s // self.n for s in self.sums]
        self.base = np.array(whole, dtype=np.int64)
        self.rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest


class FitList:
    """Distinct vectors of one length, packed into rows of up to _PACK, in the shared folder."""

    def __init__(self, vectors: DataFrame, d: int):
        """``vectors`` has one column, array<bigint> of length d."""
        self.d, self.spark = d, vectors.sparkSession
        self.packs = materialise(vectors.distinct().mapInArrow(lambda it: _pack(it, d), "pack binary"))
        self.tasks = self.packs.rdd.getNumPartitions()  # of a scan: no job runs
        self.centre = self._sums()

    def _sums(self) -> Centre | None:
        d = self.d

        def part(batches):
            n, high, low = 0, np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
            for x in _packs(batches, d):  # halves of 26 bits, so that no partial sum overflows
                n += len(x)
                high += (x >> 26).sum(axis=0)
                low += (x & ((1 << 26) - 1)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d), pa.int32()), pa.array(np.append(0, high), pa.int64()),
                                              pa.array(np.append(n, low), pa.int64())], names=["i", "high", "low"])

        exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
        got = {r["i"]: (int(r["high"]) << 26) + int(r["low"])
               for r in self.packs.mapInArrow(part, "i int, high long, low long").groupBy("i").agg(exact("high").alias("high"), exact("low").alias("low")).collect()}
        return Centre(got[-1], [got[i] for i in range(d)]) if got.get(-1) else None

    def total(self, partial, shape: tuple[int, int]) -> np.ndarray:
        """Sum over all packs of ``partial(y)``, a matrix of this shape for each pack of centred vectors."""
        d, centre = self.d, self.spark.sparkContext.broadcast(self.centre)

        def part(batches):
            out = np.zeros(shape)
            for x in _packs(batches, d):
                out += partial(centre.value.of(x))
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sum"])

        def merge(batches):
            out = np.zeros(shape)
            for batch in batches:
                for blob in batch.column(0):
                    out += np.frombuffer(blob.as_buffer()).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sum"])

        parts = self.packs.mapInArrow(part, "sum binary")
        if self.tasks * shape[0] * shape[1] * 8 > _DIRECT:
            parts = parts.repartition(math.ceil(math.sqrt(self.tasks))).mapInArrow(merge, "sum binary")
        out = np.sum([np.frombuffer(r["sum"]).reshape(shape) for r in parts.collect()], axis=0)
        centre.unpersist()
        return out

    def product(self, q: np.ndarray) -> np.ndarray:
        """Covariance times the columns of q."""
        shared = self.spark.sparkContext.broadcast(np.ascontiguousarray(q))
        out = self.total(lambda y: y.T @ (y @ shared.value), q.shape) / self.centre.n
        shared.unpersist()
        return out


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(axis=0))


def minres(product, q: np.ndarray, theta: np.ndarray, b: np.ndarray, steps: int, reduction: float) -> np.ndarray:
    """Approximate t with (I - QQ')(A - theta_i I)(I - QQ') t_i = b_i, all columns together; ``product`` is called once a step.

    A column rests once its residual has fallen by ``reduction``.
    """
    off = lambda a: a - q @ (q.T @ a)
    y = off(b)
    r1, r2 = y, y
    first = beta = _norms(y)
    t, w, w2 = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    old = np.ones_like(beta)
    dbar, epsln, sn, cs, phibar = np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta), -np.ones_like(beta), beta.copy()
    tiny = np.finfo(float).tiny
    for step in range(steps):
        live = (phibar > reduction * first) & (beta > 1e-14 * first) & (first > 0)
        if not live.any():
            break
        v = y / np.maximum(beta, tiny)
        y = np.zeros_like(v)
        y[:, live] = product(v[:, live])
        y = off(y - v * theta)
        if step:
            y = y - (beta / old) * r1
        alfa = (v * y).sum(axis=0)
        y = off(y - (alfa / np.maximum(beta, tiny)) * r2)
        r1, r2, old, beta = r2, y, np.maximum(beta, tiny), _norms(y)
        oldeps, delta, gbar = epsln, cs * dbar + sn * alfa, sn * dbar - cs * alfa
        epsln, dbar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(gbar, beta), tiny)
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, np.where(live, sn * phibar, phibar)
        w, w2 = (v - oldeps * w2 - delta * w) / gamma, w
        t[:, live] += (phi * w)[:, live]
    return off(t)


def jacobi_davidson(product, d: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns, residual norms) of the k largest pairs of a symmetric operator.

    ``product`` maps a d x m matrix; it is the only use of the operator.
    """
    k = min(k, d)
    wide = min(d, k + GUARD)
    limit = min(d, wide + 2 * k)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, wide)))[0]
    image = product(basis)
    tol, best, idle = 8 * np.finfo(float).eps * math.sqrt(d), math.inf, 0
    for _ in range(OUTER_STEPS):
        h = basis.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        m = min(wide, len(values))
        q, aq = basis @ turn[:, :m], image @ turn[:, :m]
        r = aq[:, :k] - q[:, :k] * values[:k]
        size = max(float(abs(values[0])), np.finfo(float).tiny)
        rest = _norms(r) / size
        open_ = rest > tol  # the others are locked
        idle = 0 if rest.max() < best / 2 else idle + 1
        best = min(best, float(rest.max()))
        if not open_.any() or basis.shape[1] == d or (idle >= 3 and best < 1e-12):
            break
        if basis.shape[1] + int(open_.sum()) > limit:
            basis = np.linalg.qr(q)[0]
            image = product(basis)
        t = minres(product, q, values[:k][open_], -r[:, open_], INNER_STEPS, INNER_REDUCTION)
        t = t / np.maximum(_norms(t), np.finfo(float).tiny)
        for _ in range(2):
            t = t - basis @ (basis.T @ t)
            u, s, _v = np.linalg.svd(t, full_matrices=False)
            t = u[:, s > 1e-10 * max(s[0], np.finfo(float).tiny)][:, :d - basis.shape[1]]
        if not t.shape[1]:
            break
        basis, image = np.hstack([basis, t]), np.hstack([image, product(t)])
    # pairs of a fresh product, without the rounding of rotated images
    q = np.linalg.qr(q[:, :wide])[0]
    aq = product(q)
    h = q.T @ aq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    vectors = q @ turn
    return values, vectors / _norms(vectors), _norms(aq @ turn - vectors * values)


@dataclass
class Whitening:
    """A fitted whitening: ``weights`` maps a centred vector to whitened coordinates."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float

    @property
    def weights(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit_whitening(vectors: DataFrame, vec_col: str, k: int = COMPONENTS) -> Whitening | None:
    """Fitted on each distinct vector of the commonest length once; None without vectors or without variance."""
    vec = F.col(f"`{vec_col}`")
    lengths = vectors.where(vec.isNotNull() & (F.size(vec) > 0)).groupBy(F.size(vec).alias("d")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if first is None:
        return None
    d = int(first["d"])
    fit = FitList(vectors.where(F.size(vec) == d).select(vec.alias("x")), d)
    trace = float(fit.total(lambda y: np.array([[(y * y).sum()]]), (1, 1))[0, 0]) / fit.centre.n
    if not trace > 0:
        return None
    values, found, rest = jacobi_davidson(fit.product, d, k)
    real = values > d * np.finfo(float).eps * trace  # directions without variance can't be scaled to one
    out = Whitening(fit.centre, values[real], found[:, real], rest[real], trace, 0.0)
    m, weights = int(real.sum()), fit.spark.sparkContext.broadcast(out.weights)

    def moments(y):
        z = y @ weights.value
        return np.vstack([z.T @ z, z.sum(axis=0)])

    sums = fit.total(moments, (m + 1, m)) / fit.centre.n
    out.identity_error = float(np.abs(sums[:m] - np.outer(sums[m], sums[m]) - np.eye(m)).max())
    return out


def deviations(x: np.ndarray, centre: Centre) -> list[int | None]:
    """sum over dimensions of (n x - S)**2, exact; None where that is beyond a long."""
    far = np.abs(centre.of(x)).max(initial=0.0) * centre.n
    if far * far * max(1, x.shape[1]) < 2.0 ** 62 and np.abs(x).max(initial=0) * float(centre.n) < 2.0 ** 62 and all(abs(s) < 2 ** 62 for s in centre.sums):
        apart = x * np.int64(centre.n) - np.array(centre.sums, dtype=np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = (sum((centre.n * v - s) ** 2 for v, s in zip(row, centre.sums)) for row in x.tolist())
    return [e if e < 1 << 63 else None for e in exact]


def _whitened(batches, model, d):
    fit = model.value
    k = len(fit.values)
    for batch in batches:
        column = batch.column(1)
        for at in range(0, batch.num_rows, 4_096 // max(1, k) + 1):
            rows = batch.slice(at, 4_096 // max(1, k) + 1)
            column = rows.column(1)
            x = _matrix(column, d)
            n = len(x)
            z = fit.centre.of(x) @ fit.weights
            each = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays([
                rows.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, fit.centre.n), pa.int64()),
                pa.array(deviations(x, fit.centre), pa.int64()).take(each), pa.array(z.ravel(), pa.float64()),
                pa.array(np.tile(fit.values / fit.trace, n), pa.float64()), pa.array(np.full(n * k, fit.identity_error), pa.float64())],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): up to ``k`` rows for each row of ``vectors``.

    ``vec_col`` is array<bigint> without null entries.  The fit uses each distinct vector
    once: n of them, covariance with divisor n.  Components are numbered from 1 by falling
    variance; ``explained`` is a component's share of the whole variance, ``identity_error``
    the largest entry of the whitened fit list's covariance minus the identity.

    Rows with a null or empty vector, or with one of another than the commonest length
    (ties: the longer), are left out.  Repeated rows and ids pass through, as do null ids.
    Directions without variance are no components: equal vectors, a single one or an empty
    table give no rows.  ``deviation``, exact, is null where it is beyond a long.  Other
    columns are never read.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("x"))
    kind = base.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = fit_whitening(base, "x", k)
    if fit is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    model, d = spark.sparkContext.broadcast(fit), len(fit.centre.sums)  # d x k numbers
    return base.where(F.size("x") == d).mapInArrow(lambda it: _whitened(it, model, d), schema).withColumnRenamed("id", id_col)
