"""Embedding whitening: a distributed centred covariance and its leading eigenvectors.

Entries become whole numbers ``floor(scale * c) + shift``, so equal vectors are equal exactly.  The fit
list holds each distinct vector once; its sums are exact and its covariance is added up in the tasks
after centring, one ``d x d`` partial per task, row by row over the shuffle.  The driver gets the finished matrix
(``d * d`` doubles, a size set by the dimension and not by the rows) and finds the components:
Householder reflections to a tridiagonal matrix, bisection by Sturm counts for the leading eigenvalues,
inverse iteration for their vectors, with those of close eigenvalues orthogonalised again.
Mean and projection (``d * k`` doubles) are broadcast and every row is projected where it is read.

Defined cases: rows whose vector is null, or has null or non-finite entries, are left out; so are
vectors without entries and those of another length than most have (the longer at a tie).  Repeated rows stay and
count once in the fit; a null id stays; components of no variance (an eigenvalue below ``d * 2^-52``
of the largest) cannot be scaled to one and are left out, so vectors that are all equal, or an empty
table, give no rows.  Whole numbers and deviations beyond 64 bits are an error, never a wrong number.
Extra columns stay in ``whiten`` (the name ``whitened`` is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Staging, bounded_batches

COMPONENTS = 16
_SPREAD = 64  # rows of partial matrices are first added in this many parts
_BLOCK = 8192
_EPS = float(np.finfo(float).eps)


def finite(vector: Column) -> Column:
    """True where the vector has entries, all of them finite numbers."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def whole_numbers(vector: Column, scale: int, shift: int) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift).cast("long"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Equal-length lists of longs as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


@dataclass
class Whitening:
    """The fit: ``n`` vectors, their exact ``sums``, components (columns of ``vectors``) by falling eigenvalue, the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the nearest whole number is taken off exactly, then the fraction."""
        return (x - self._near()) - self._fraction()

    def _near(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    def _fraction(self) -> np.ndarray:
        return np.array([(s % self.n) / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n*x - S)^2, exactly."""
        near = self._near()
        rest = np.array([s % self.n for s in self.sums], object)
        y = x - near  # n*x - S = n*y - (S mod n)
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * y - rest.astype(np.int64)) ** 2).sum(axis=1)
        out = [sum((self.n * int(a) - b) ** 2 for a, b in zip(row, rest)) for row in y]
        if max(out, default=0) >= 1 << 63:
            raise OverflowError("a deviation is beyond 64 bits")
        return np.array(out, np.int64)


# --- symmetric eigenproblem -----------------------------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal and the Householder vectors (first row, unit vector) of a symmetric matrix."""
    a, n, mirrors = np.array(matrix, float), len(matrix), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or size == abs(x[0]):
            continue
        x[0] += size if x[0] >= 0 else -size
        u = x / np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        w = 2 * (p - (u @ p) * u)
        rest -= np.outer(u, w) + np.outer(w, u)
        a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        mirrors.append((k + 1, u))
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def count_below(diagonal: np.ndarray, squares: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each point."""
    q = diagonal[0] - at
    below = (q < 0).astype(np.int64)
    for d, s in zip(diagonal[1:], squares):
        q = np.where(np.abs(q) < least, -least, q)
        q = d - at - s / q
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    n = len(diagonal)
    around = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    norm = float(np.max(np.abs(diagonal) + around))
    squares, least = off**2, max(norm * _EPS * _EPS, np.finfo(float).tiny)
    lo, hi = np.full(k, float(np.min(diagonal - around)) - norm * _EPS * n), np.full(k, float(np.max(diagonal + around)) + norm * _EPS * n)
    rank = n - 1 - np.arange(k)  # this many eigenvalues are smaller
    while True:
        mid = (lo + hi) / 2
        if not np.any((mid > lo) & (mid < hi)):
            return mid
        low = count_below(diagonal, squares, mid, least) <= rank
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)


def _factors(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """LU of the shifted tridiagonal matrix with row exchanges; a solver for right-hand sides."""
    n = len(diagonal)
    upper = np.zeros((n, 3))
    steps = []
    row = np.array([diagonal[0] - shift, off[0] if n > 1 else 0.0, 0.0])
    for i in range(n - 1):
        below = np.array([off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < n else 0.0])
        swap = abs(below[0]) > abs(row[0])
        if swap:
            row, below = below, row
        if abs(row[0]) < least:
            row[0] = least
        factor = below[0] / row[0]
        upper[i] = row
        row = np.array([below[1] - factor * row[1], below[2] - factor * row[2], 0.0])
        steps.append((swap, factor))
    upper[n - 1] = [row[0] if abs(row[0]) >= least else least, 0, 0]

    def solve(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                b[i], b[i + 1] = b[i + 1], b[i]
            b[i + 1] -= factor * b[i]
        for i in range(n - 1, -1, -1):
            rest = upper[i, 1] * b[i + 1] if i + 1 < n else 0.0
            rest += upper[i, 2] * b[i + 2] if i + 2 < n else 0.0
            b[i] = (b[i] - rest) / upper[i, 0]
        return b

    return solve


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; those of close eigenvalues are orthogonalised at every step."""
    n, draw = len(diagonal), np.random.default_rng(7)
    norm = float(np.max(np.abs(diagonal)) + 2 * np.max(np.abs(off), initial=0.0)) or 1.0
    least, out, cluster = max(norm * _EPS, np.finfo(float).tiny), np.zeros((n, len(values))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            cluster = k
        close = out[:, cluster:k]
        # equal eigenvalues get shifts a little apart, so that their solves differ
        solve = _factors(diagonal, off, value - (k - cluster) * least, least)
        v = draw.standard_normal(n)
        for _ in range(6):
            v = solve(v / np.max(np.abs(v)))
            for _ in range(2):
                v -= close @ (close.T @ v)
            v /= np.linalg.norm(v)
        out[:, k] = v
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    diagonal, off, mirrors = tridiagonal(matrix)
    values = leading_values(diagonal, off, min(k, len(diagonal)))
    vectors = leading_vectors(diagonal, off, values)
    for first, u in reversed(mirrors):
        vectors[first:] -= 2 * np.outer(u, u @ vectors[first:])
    return values, vectors


# --- the fit --------------------------------------------------------------------------------------

def _added(partials: DataFrame, width: int) -> dict[int, np.ndarray]:
    """``(i, part, row)`` partial rows of a matrix of ``width`` columns, added per ``i``: within parts first, then over them."""
    def add(rows: pa.Table) -> pa.Table:
        total = rows["row"].combine_chunks().flatten().to_numpy().reshape(-1, width).sum(axis=0)
        return pa.table({"i": rows["i"][:1], "part": rows["part"][:1], "row": pa.array([total.tolist()], pa.list_(pa.float64()))})

    schema = "i int, part int, row array<double>"
    once = partials.groupBy("i", "part").applyInArrow(add, schema)
    rows = once.groupBy("i").applyInArrow(add, schema).select("i", "row").toArrow().to_pylist()
    return {r["i"]: np.array(r["row"]) for r in rows}


def _products(vectors: DataFrame, fit: Whitening, projected: bool, mean: np.ndarray | None = None) -> DataFrame:
    """Per task: row ``i`` of the sum of centred outer products of its vectors (or of their whitened values); row -1 holds the plain sums."""
    shared = vectors.sparkSession.sparkContext.broadcast((fit, mean))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, middle = shared.value
        total = plain = None
        for batch in batches:
            x = _matrix(batch.column(0)) if batch.num_rows else None
            for at in range(0, batch.num_rows, _BLOCK):
                part = x[at : at + _BLOCK]
                y = model.project(part) if projected else model.centred(part)
                y = y if middle is None else y - middle
                total = y.T @ y if total is None else total + y.T @ y
                plain = y.sum(axis=0) if plain is None else plain + y.sum(axis=0)
        if total is not None:
            rows, bucket = [plain.tolist(), *total.tolist()], TaskContext.get().partitionId() % _SPREAD
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([bucket] * len(rows), pa.int32()),
                                              pa.array(rows, pa.list_(pa.float64()))], names=["i", "part", "row"])

    return vectors.select("x").mapInArrow(work, "i int, part int, row array<double>")


def _covariance(vectors: DataFrame, fit: Whitening, width: int, projected: bool = False, mean: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (divisor n) of what ``_products`` multiplies."""
    rows = _added(_products(vectors, fit, projected, mean), width)
    return rows[-1] / fit.n, np.array([rows[i] for i in range(width)]) / fit.n


def _sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Row count and exact sums per dimension (decimals, as long as the counts go)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            x = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, width), np.int64)
            n += len(x)
            for at in range(0, len(x), _BLOCK):
                part = x[at : at + _BLOCK]
                small = int(np.abs(part).max(initial=0)) < 1 << 49
                total = total + (part.sum(axis=0) if small else part.astype(object).sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(n), *map(str, total)])], names=["i", "amount"])

    added = (vectors.select("x").mapInArrow(work, "i int, amount string")
             .groupBy("i").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect())
    by = {r.i: int(r.amount) for r in added}
    return by.get(-1, 0), [by.get(i, 0) for i in range(width)]


def prepared(frame: DataFrame, column: str, scale: int, shift: int) -> tuple[DataFrame, int]:
    """The usable rows with their whole numbers ``__x``, and the length most vectors have (0 where there are none)."""
    vector = F.col(f"`{column}`")
    usable = frame.where(finite(vector))
    length = usable.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    if length is None:
        return usable.withColumn("__x", F.lit(None).cast("array<bigint>")), 0
    return usable.where(F.size(vector) == length.d).withColumn("__x", whole_numbers(vector, scale, shift)), length.d


def fit_whitening(frame: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = 64, shift: int = 1_000_000) -> Whitening | None:
    """Fitted on each distinct vector of ``frame`` once; None where there is nothing to fit."""
    bounded_batches(frame.sparkSession)
    rows, width = prepared(frame, column, scale, shift)
    return _fit(rows, width, components) if width else None


def _fit(rows: DataFrame, width: int, components: int) -> Whitening | None:
    staging = Staging(rows.sparkSession, "whitening")
    try:
        vectors = staging.table("vectors", rows.select(F.col("__x").alias("x")).distinct())
        n, sums = _sums(vectors, width)
        fit = Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)
        _, matrix = _covariance(vectors, fit, width)
        fit.trace = float(np.trace(matrix))
        if fit.trace <= 0:
            return None
        values, found = leading_components((matrix + matrix.T) / 2, components)
        keep = values > width * _EPS * values[0]
        fit.values, fit.vectors = values[keep], found[:, keep]
        # measured on the whitened vectors themselves, centred by their own mean
        k = len(fit.values)
        mean, _ = _covariance(vectors, fit, k, projected=True)
        _, after = _covariance(vectors, fit, k, projected=True, mean=mean)
        fit.identity_error = float(np.max(np.abs(after - np.eye(k))))
        return fit
    finally:
        staging.remove()


def whiten(frame: DataFrame, fit: Whitening | None = None, column: str = "embedding", components: int = COMPONENTS, scale: int = 64,
           shift: int = 1_000_000, exact: bool = False) -> tuple[DataFrame, Whitening | None]:
    """The usable rows with ``whitened`` (an array, one entry per component), and the fit they were projected by.

    ``exact`` adds ``__deviation``, the exact sum over the dimensions of (n*x - S)^2."""
    spark = frame.sparkSession
    bounded_batches(spark)
    rows, width = prepared(frame.drop("whitened"), column, scale, shift)
    fit = fit or (_fit(rows, width, components) if width else None)
    added = "whitened array<double>" + (", __deviation long" if exact else "")
    if fit is None or len(fit.sums) != width:
        nothing = rows.drop("__x").limit(0).withColumn("whitened", F.lit(None).cast("array<double>"))
        return (nothing.withColumn("__deviation", F.lit(None).cast("long")) if exact else nothing), fit
    kept = rows.drop("__x").columns
    shared = spark.sparkContext.broadcast(fit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(batch.num_columns - 1))
            z = np.ascontiguousarray(model.project(x))
            bounds = pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1])
            made = [pa.ListArray.from_arrays(bounds, pa.array(z.reshape(-1)))]
            names = [*batch.schema.names[:-1], "whitened"]
            if exact:
                made, names = [*made, pa.array(model.deviation(x), pa.int64())], [*names, "__deviation"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    types = dict(rows.dtypes)
    fields = [f"`{c.replace('`', '``')}` {types[c]}" for c in kept]
    return rows.select(*[F.col(f"`{c}`") for c in kept], "__x").mapInArrow(work, ", ".join([*fields, added])), fit


def whitening_digest(frame: DataFrame) -> DataFrame:
    """The contract's columns from ``whiten``: a row per vector and component."""
    rows, fit = whiten(frame.select("vec_id", "embedding"), exact=True)
    share = [float(v) / fit.trace for v in fit.values] if fit is not None else []
    by = F.array(*[F.lit(s) for s in share]).cast("array<double>")
    return (rows.select("vec_id", "__deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n if fit else 0).cast("long").alias("n"),
                    F.col("__deviation").alias("deviation"), "whitened", F.get(by, F.col("at")).alias("explained"),
                    F.lit(fit.identity_error if fit else 0.0).alias("identity_error")))
