"""Embedding whitening: principal components by QDWH spectral divide-and-conquer.

Entries become integers (256ths, rounded down). The covariance of the distinct integer
vectors is exact: tasks sum centred products in integers, one row per matrix entry, and
Spark adds these up; only one d x d matrix reaches the driver. There the matrix is split:
the polar factor of the matrix less a shift, found by the QR-based dynamically weighted
Halley iteration, is the matrix sign; half of it plus the identity projects on the subspace
of the eigenvalues above the shift. Both subspaces are split in turn, down to single
components. The leading ones are broadcast, and tasks project and scale every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyscope.llm.common import read, stage

# Fixed values of the production run.
SCALE = 256
COMPONENTS = 4
LIMB = 18  # bits of a factor: products of 8,192 rows then add up exactly in doubles
ROWS = 1 << 13
MOST = 1 << 61  # larger entries are cut to it
PART = 40  # bits of a summed part


def polar_factor(a: np.ndarray, most_steps: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH with QR factorisations."""
    n = len(a)
    norm = np.linalg.norm(a, 2)
    if norm == 0:
        return np.eye(n)
    x = a / norm
    low = min(max(float(np.linalg.svd(x, compute_uv=False)[-1]) * 0.9, 1e-17), 1.0)
    for _ in range(most_steps):
        s = low * low
        d = np.cbrt(4 * (1 - s) / (s * s))
        root = np.sqrt(1 + d)
        # weights of the Halley step that is best for singular values in [low, 1]
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - s) / (s * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(low * (wa + wb * s) / (1 + wc * s), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if moved < 1e-14 * n and low > 1 - 1e-12:
            break
    return x


def _range(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of its complement: QR with the columns
    of largest rest taken first, done twice for orthogonality."""
    n = len(projector)
    rest, picked = projector.copy(), []
    for _ in range(rank):
        j = int(np.argmax((rest * rest).sum(axis=0)))
        v = rest[:, j] / np.linalg.norm(rest[:, j])
        picked.append(v)
        rest -= np.outer(v, v @ rest)
    basis = projector @ np.array(picked).T
    q, _ = np.linalg.qr(np.hstack([basis, np.eye(n)]))
    return q[:, :rank], q[:, rank:n]


def spectral_split(a: np.ndarray, tiny: float | None = None) -> np.ndarray:
    """Orthonormal eigenvectors (columns) of a symmetric matrix, by divide-and-conquer."""
    n = len(a)
    tiny = np.finfo(float).eps * max(np.linalg.norm(a), np.finfo(float).tiny) if tiny is None else tiny
    off = a - np.diag(np.diag(a))
    if n == 1 or np.linalg.norm(off) <= tiny:
        return np.eye(n)
    values = np.sort(np.diag(a))
    shifts = [float(np.median(values)), float(values.mean()), float((values[0] + values[-1]) / 2)]
    shifts += [s + w * (np.linalg.norm(off) + values[-1] - values[0]) for s in shifts for w in (0.01, -0.013, 0.1, -0.17)]
    best = None
    for shift in shifts:
        sign = polar_factor(a - shift * np.eye(n))
        rank = int(round((np.trace(sign) + n) / 2))
        if not 0 < rank < n:
            continue
        upper, lower = _range((sign + np.eye(n)) / 2, rank)
        error = np.linalg.norm(lower.T @ a @ upper)
        if best is None or error < best[0]:
            best = (error, upper, lower)
        if error <= 32 * n * tiny:
            break
    if best is None:  # all eigenvalues agree to rounding
        return np.eye(n)
    _, upper, lower = best
    halves = []
    for basis in (upper, lower):
        part = basis.T @ a @ basis
        halves.append(basis @ spectral_split((part + part.T) / 2, tiny))
    return np.hstack(halves)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    q = spectral_split(a)
    for _ in range(3):  # first-order corrections take what rounding the splits left
        q, r = np.linalg.qr(q)
        q = q * np.where(np.diag(r) < 0, -1.0, 1.0)
        b = q.T @ a @ q
        e = np.diag(b)
        gap = e[None, :] - e[:, None]
        far = np.abs(gap) > 1e3 * np.abs(b) + np.finfo(float).eps * np.abs(e).max(initial=0.0)
        turn = np.where(far, b / np.where(far, gap, 1.0), 0.0)
        np.fill_diagonal(turn, 0.0)
        q = q + q @ turn
    q, r = np.linalg.qr(q)
    e = np.einsum("ij,ik,kj->j", q, a, q)
    order = np.argsort(-e, kind="stable")
    return e[order], q[:, order]


def _usable(vector: str) -> Column:
    """Rows whose vector is there and holds finite numbers only."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return v.isNotNull() & finite


def to_integers(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers of a list column; vectors that end early go on with zeros."""
    first = np.asarray(column.offsets, dtype=np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(first)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    flat = np.clip(scaled, -float(MOST), float(MOST)).astype(np.int64)
    out = np.zeros((len(size), dims), dtype=np.int64)
    at = np.arange(first[0], first[-1])
    row = np.repeat(np.arange(len(size)), size)
    out[row, at - first[:-1][row]] = flat[at]
    return out


def _parts(values: list[int]) -> list[list[int]]:
    """Whole numbers as four parts that can be summed as longs: three of 40 bits, and the rest."""
    mask = (1 << PART) - 1
    return [[v >> (PART * k) & mask if k < 3 else v >> (PART * 3) for v in values] for k in range(4)]


def _summed(parts: DataFrame) -> dict[int, int]:
    """Exact sums of ``parts`` (cell, p0..p3) by cell."""
    total = parts.groupBy("cell").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(4)])
    return {r.cell: sum(r[f"p{k}"] << (PART * k) for k in range(4)) for r in total.collect()}


_PARTS = "cell long, " + ", ".join(f"p{k} long" for k in range(4))


def _cells(cells: np.ndarray, values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells), *(pa.array(p, pa.int64()) for p in _parts(values))], names=["cell", *(f"p{k}" for k in range(4))])


def _integers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a column of packed integers."""
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i8").reshape(-1, dims)


def products(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns of whole numbers, as Python integers: factors
    are cut into limbs, whose products add up exactly in doubles."""
    d = y.shape[1]
    total = np.zeros((d, d), dtype=object)
    for a in range(0, len(y), ROWS):
        rest, limbs = y[a : a + ROWS], []
        while rest.any():
            low = ((rest + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
            limbs.append(low.astype(np.float64))
            rest = (rest - low) >> LIMB
        for i, p in enumerate(limbs):
            for j, q in enumerate(limbs):
                total += (p.T @ q).astype(np.int64).astype(object) * (1 << (LIMB * (i + j)))
    return total


def fit_list(embeddings: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """(x) each distinct vector of whole numbers once, packed as little-endian longs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = to_integers(batch.column("v"), dims).astype("<i8").tobytes()
            step = 8 * dims
            yield pa.RecordBatch.from_arrays([pa.array([raw[i * step : (i + 1) * step] for i in range(batch.num_rows)], pa.binary())], names=["x"])

    packed = embeddings.where(_usable(vector)).select(F.col(vector).alias("v")).mapInArrow(work, "x binary")
    return packed.distinct()


class Whitening:
    """What is learnt: n, the sums per dimension, components (rows) and their eigenvalues."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.components, self.values, self.trace = n, sums, components, values, trace
        self.base = np.array([s // n for s in sums], dtype=np.int64)
        self.mean_rest = np.array([float(Fraction(s, n) - s // n) for s in sums])
        # a value that rounding alone can make gives no scale
        self.used = values > len(sums) * np.finfo(float).eps * max(trace, 0.0) if trace > 0 else np.zeros(len(values), bool)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN for components without variance."""
        centred = (x - self.base).astype(np.float64) - self.mean_rest
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.used, centred @ self.components.T / np.sqrt(np.where(self.used, self.values, np.nan)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2; None beyond a long."""
        most = max((abs(int(x.min())), abs(int(x.max()))), default=0) * self.n + max(map(abs, self.sums), default=0) if x.size else 0
        if most * most * max(1, x.shape[1]) < 1 << 62:
            y = x * self.n - np.array(self.sums, dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """Learn from the fit list (x); None if it is empty."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, object), np.zeros(dims, object)
        for batch in batches:
            x = _integers(batch, dims)
            n += len(x)
            high += (x >> 31).sum(axis=0).astype(object)
            low += (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
        yield _cells(np.arange(-1, dims), [n, *((h << 31) + v for h, v in zip(high.tolist(), low.tolist(), strict=True))])

    first = _summed(vectors.mapInArrow(sums, _PARTS))
    n = first.get(-1, 0)
    if not n:
        return None
    total = [first[i] for i in range(dims)]
    base = np.array([s // n for s in total], dtype=np.int64)
    upper = np.triu_indices(dims)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((dims, dims), dtype=object)
        for batch in batches:
            out += products(_integers(batch, dims) - base)
        yield _cells(np.arange(len(upper[0])), out[upper].tolist())

    second = _summed(vectors.mapInArrow(squares, _PARTS))
    # Centred at whole numbers next to the means; the rest of the means is taken off exactly.
    rest = [s - n * int(b) for s, b in zip(total, base, strict=True)]
    exact = {}
    for k, (i, j) in enumerate(zip(*(u.tolist() for u in upper), strict=True)):
        exact[i, j] = n * second[k] - rest[i] * rest[j]
    v = np.zeros((dims, dims))
    for (i, j), value in exact.items():
        v[i, j] = v[j, i] = value / (n * n)
    values, vectors_ = eigen(v) if dims else (np.zeros(0), np.zeros((0, 0)))
    trace = sum(exact[i, i] for i in range(dims)) / (n * n)
    most = min(components, dims)
    return Whitening(n, total, vectors_[:, :most].T.copy(), np.maximum(values[:most], 0.0), trace)


def identity_error(vectors: DataFrame, dims: int, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over
    the components that have variance; None if there is none."""
    used = np.flatnonzero(model.used)
    k = len(used)
    if not k:
        return None

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(model.project(_integers(batch, dims))[:, used].sum(axis=0))], names=["cell", "s"])

    def total(work) -> dict[int, float]:
        return {r.cell: r.s for r in vectors.mapInArrow(work, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()}

    first = total(means)
    mean = np.array([first[i] / model.n for i in range(k)])

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = model.project(_integers(batch, dims))[:, used] - mean
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array((w.T @ w).ravel())], names=["cell", "s"])

    second = total(squares)
    covariance = np.array([second[i] / model.n for i in range(k * k)]).reshape(k, k)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """Per usable row and component: vec_id, component (from 1), n, deviation, whitened,
    explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are dropped. Vectors of
    fewer entries than the longest go on with zeros; an empty one is all zeros. Integers
    beyond 2^61 are cut to it. Repeated rows, and rows without vec_id, each give their
    rows, but count once in what is learnt. A component without variance (one distinct
    vector, say) has whitened null and explained 0 or so; identity_error is over the others,
    null without any. A deviation beyond a long is null. No usable rows give no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", F.col(vector).alias("v")).where(_usable("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return spark.createDataFrame([], schema)
    vectors = stage(fit_list(rows, dims, "v"))
    model = fit(vectors, dims, components)
    error = identity_error(vectors, dims, model)
    sent = spark.sparkContext.broadcast(model)  # a few vectors of the table's dimension

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Whitening = sent.value
        k = len(m.values)
        explained = np.where(m.used, m.values, 0.0) / (m.trace if m.trace > 0 else 1.0)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x = to_integers(part.column("v"), dims)
                size = len(x)
                row = pa.array(np.repeat(np.arange(size), k))
                whitened = m.project(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, m.n)),
                     pa.array(m.deviations(x), pa.int64()).take(row), pa.array(whitened, mask=np.isnan(whitened)), pa.array(np.tile(explained, size)),
                     pa.array([error] * (size * k), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(work, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of ``embeddings``, whitened on four components."""
    return whiten(read(spark, sf_dir, "embeddings"))
