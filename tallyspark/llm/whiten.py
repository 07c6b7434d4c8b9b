"""Operator 13: embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The fit list (each distinct integer vector once) is written once; X stands for its centred
rows. A step of the bidiagonalisation alternates two distributed products over it,

    alpha_j u_j = X v_j - beta_(j-1) u_(j-1)        beta_j v_(j+1) = X'u_j - alpha_j v_j

both made in one scan, block by block. A left vector has an entry a row, but lies in the range
of X, so it is kept as the d numbers w with u = X w: nothing of the table's length is stored or
sent, and a lost executor costs only its blocks. Both sides are reorthogonalised in full: v
against all earlier right vectors twice; u against all earlier left ones by X'u_i, known from
their steps, and again by overlaps summed over the rows. A step sends d + j + 1 sums.

The small bidiagonal's singular values and right vectors give deviations and components. When
a step finds nothing new (beta is 0), a fresh direction orthogonal to all others goes on, so
repeated eigenvalues are found as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship
from .token_files import shared_path

SCALE = 256
ZERO = 1e-11  # a singular value this small, against the largest, is none


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x = floor(256 c) of the entries as doubles, as longs.

    Left out: vectors that are null, empty, hold a null or an entry that is not finite, or have
    another length than most (the greater length on a tie). Repeated and null vec_ids stay.
    Entries beyond a long's range become its end.
    """
    entries = F.transform(F.col(column), lambda c: c.cast("double"))
    good = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select("vec_id", entries.alias("c")).where(F.size("c") > 0).where(good)
    length = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    most = 9223372036854774784.0  # the last double that is a long
    long = lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * SCALE, F.lit(most)), F.lit(-most))), F.lit(int(most))), F.lit(-int(most)))
    rows = rows.where(F.size("c") == (length["d"] if length else 0))
    return rows.select("vec_id", F.transform("c", lambda c: long(c).cast("long")).alias("x"))


@dataclass
class Whitening:
    """A fitted model: sizes, exact sums, components (rows) and their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as an integer matrix."""
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _sums(fit: DataFrame, size: int, part: Callable) -> np.ndarray:
    """Sum over the fit list of ``part(x)``, ``size`` doubles a block; added up in Spark by index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch["x"]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "value"])

    out = np.zeros(size)
    for i, value in fit.mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value")).collect():
        out[i] = value
    return out


def _exact_sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, [0] * size
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["x"])
                rows += len(x)
                x = x if np.abs(x.astype(float)).max() < 1 << 40 else x.astype(object)
                total = [a + int(b) for a, b in zip(total, x.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([str(v) for v in (rows, *total)])], ["i", "value"])

    got = fit.mapInArrow(run, "i int, value string").groupBy("i").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect()
    found = {i: int(v) for i, v in got}
    return found.get(-1, 0), [found.get(i, 0) for i in range(size)]


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """What is left of v beside all of ``basis``; twice, for rounding."""
    if basis:
        b = np.array(basis)
        for _ in range(2):
            v = v - (b @ v) @ b
    return v


def _fresh(rng: np.random.Generator, d: int, basis: list[np.ndarray]) -> np.ndarray:
    v = _orthogonal(rng.standard_normal(d), basis)
    return v / np.linalg.norm(v)


def bidiagonalise(product: Callable, d: int, count: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``count`` largest singular values, their right vectors (rows), and the steps taken.

    ``product(w, W)`` returns X'u, the overlaps of u with the earlier left vectors X W', and
    |u| squared, for u = X w. Stops when the wanted values have settled twice, the second time
    from a fresh direction (which would show a repeated value), or after d steps, when the
    bidiagonal is whole.
    """
    rng = np.random.default_rng(13)
    right, left, back, alphas, betas = [], [], [], [], []
    v, beta, scale, settled = _fresh(rng, d, []), 0.0, 0.0, None
    values, vectors = np.zeros(0), np.zeros((0, d))
    most = min(d, most or d)
    for step in range(most):
        w = v.copy()
        if left:
            w -= (np.array(back) @ v) @ np.array(left)
        right.append(v)
        z, overlaps, length = product(w, np.array(left).reshape(len(left), d))
        if left:
            w = w - overlaps @ np.array(left)
            z = z - overlaps @ np.array(back)
            length = length - overlaps @ overlaps
        alpha = float(np.sqrt(max(length, 0.0)))
        scale = max(scale, alpha)
        if alpha <= ZERO * scale or scale == 0:
            alpha, w, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, z = w / alpha, z / alpha
        left.append(w)
        back.append(z)
        alphas.append(alpha)
        rest = _orthogonal(z - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        scale = max(scale, beta)
        b = np.diag(alphas) + np.diag(betas, 1)
        p, values, q = np.linalg.svd(b)
        vectors = q @ np.array(right)
        if step + 1 == most:
            break
        gaps = [min([abs(values[i] - x) for k, x in enumerate(values) if k != i], default=0.0) for i in range(min(count, len(values)))]
        done = len(values) > count and all(beta * abs(p[-1, i]) <= 1e-14 * max(gap, ZERO * values[0]) for i, gap in enumerate(gaps))
        if beta <= ZERO * scale or done:
            top = values[:count]
            if done and settled is not None and np.allclose(settled, top, rtol=1e-13, atol=0):
                break
            settled = top if done else settled
            beta, v = 0.0, _fresh(rng, d, right)
        else:
            v = rest / beta
        betas.append(beta)
    return values[:count], vectors[:count], len(alphas)


def fit(rows: DataFrame, count: int = 4) -> Whitening | None:
    """Whitening of the distinct x of ``integers``; None if there are no rows.

    Fewer than ``count`` components are returned if the covariance has a lower rank (one
    distinct vector: none). The jobs run when this is called: one that writes the fit list to the shared folder, one
    scan for the sums, one a step (as many as dimensions at most), and three for trace and check.
    """
    spark = rows.sparkSession
    ship(spark)
    path = shared_path(spark, "fit-list")
    rows.select("x").distinct().write.parquet(path)
    table = spark.read.schema("x array<bigint>").parquet(path)
    first = table.first()
    if first is None:
        return None
    d = len(first["x"])
    n, sums = _exact_sums(table, d)
    mean = np.array([s / n for s in sums])

    def product(w: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        k = len(earlier)

        def part(x: np.ndarray) -> np.ndarray:
            x = x - mean
            u = x @ w
            return np.concatenate((x.T @ u, (x @ earlier.T).T @ u, [u @ u]))

        out = _sums(table, d + k + 1, part)
        return out[:d], out[d : d + k], float(out[-1])

    values, vectors, steps = bidiagonalise(product, d, count)
    rank = int((values > ZERO * values[0]).sum()) if len(values) else 0
    values, vectors = values[:rank], vectors[:rank]
    vectors = vectors * np.sign(vectors[np.arange(rank), np.abs(vectors).argmax(axis=1)])[:, None] if rank else vectors
    eigenvalues = values**2 / n
    trace = float(_sums(table, 1, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n
    out = Whitening(n, sums, vectors, eigenvalues, trace, 0.0, steps)
    if rank:
        centre = _sums(table, rank, lambda x: whitened(x, out).sum(axis=0)) / n

        def squares(x: np.ndarray) -> np.ndarray:
            y = whitened(x, out) - centre
            return (y.T @ y).ravel()

        covariance = _sums(table, rank * rank, squares).reshape(rank, rank) / n
        out.identity_error = float(np.abs(covariance - np.eye(rank)).max())
    return out


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows on the components, in standard deviations."""
    return (x - model.mean) @ model.components.T / np.sqrt(model.eigenvalues)


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum of (n x - S) squared, exact; None beyond a long (modular arithmetic is exact below)."""
    m = 1 << 64
    sums = np.array([s % m for s in model.sums], np.uint64)
    exact = ((x.astype(np.uint64) * np.uint64(model.n % m) - sums) ** 2).sum(axis=1, dtype=np.uint64)
    about = ((float(model.n) * x - np.array(model.sums, float)) ** 2).sum(axis=1)
    return [int(v) if a < 2.0**63 * (1 - 1e-9) else None for v, a in zip(exact, about)]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """Each row of ``integers`` once a component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    if model is None or not len(model.components):
        return spark.createDataFrame([], SCHEMA)
    ship(spark)
    k = len(model.components)
    explained = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch["x"])
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"].cast(pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)), pa.array([v for v in deviations(x, model) for _ in range(k)], pa.int64()),
                pa.array(whitened(x, model).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
            ], [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
