"""Embedding whitening by QDWH spectral divide and conquer.

Entries become whole numbers (256 to a unit, rounded down), so that equal vectors, sums and deviations are exact. The fit list
has each distinct vector once; its sums and its covariance, centred before multiplying, are added up in tasks, one partial
matrix a task and PARTIALS tasks at most. The covariance, dimension by dimension and so as large for any number of rows, is
taken apart on the driver: the polar factor of the covariance less a shift is its matrix sign, whose projector splits the space
in the eigenvectors above the shift and those below; each part is split again until it has one dimension. Components that are
not asked for are not split off. All rows are then whitened with the broadcast components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import temporary, written

SCALE = 256
#: Tasks that add up a matrix each.
PARTIALS = 4096
LONG = 1 << 63
EPS = float(np.finfo(float).eps)


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite entries only."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def coded(vector: Column) -> Column:
    """The entries as longs: floor(256 * c)."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + 0)


def matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """The vectors `x` of each batch as a matrix of longs; shorter ones end in zeros."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            column = batch.column("x").slice(k, 1024)
            size, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
            out = np.zeros((len(column), dim), dtype=np.int64)
            out[np.arange(dim) < size[:, None]] = flat
            yield out


def totals(fit: DataFrame) -> tuple[int, int, np.ndarray]:
    """Of the vectors `x`: their number, the least length, and the exact sums by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows, least = np.zeros(0, dtype=object), 0, 1 << 30
        for batch in batches:
            if batch.num_rows:
                size = batch.column("x").value_lengths().to_numpy()
                rows, least = rows + len(size), min(least, int(size.min()))
                sums = np.append(sums, np.zeros(max(0, int(size.max()) - len(sums)), dtype=object))
                for x in matrices(iter([batch]), len(sums)):
                    high, low = x >> 32, x & 0xFFFFFFFF
                    sums = sums + (high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(len(sums))], pa.int32()), pa.array([str(rows), *map(str, sums)]), pa.array([least] * (len(sums) + 1), pa.int32())], names=["dim", "total", "least"]
        )

    found = fit.coalesce(PARTIALS).mapInArrow(add, "dim int, total string, least int")
    found = found.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("least").alias("least")).orderBy("dim").collect()  # a row for each dimension
    if not found:
        return 0, 0, np.zeros(0, dtype=object)
    return int(found[0]["total"]), found[0]["least"], np.array([int(r["total"]) for r in found[1:]], dtype=object)


def covariance(fit: DataFrame, dim: int, n: int, centred: Callable[[np.ndarray], np.ndarray], out: int) -> np.ndarray:
    """The covariance of what `centred` makes of the vectors `x`: centred about their mean but for rounding, of which the
    rest is taken off."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((out, out)), np.zeros(out)
        for x in matrices(batches, dim):
            c = centred(x)
            products += c.T @ c
            sums += c.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, out), pa.int32()), pa.array([sums, *products], pa.list_(pa.float64()))], names=["i", "row"])

    parts = fit.coalesce(PARTIALS).mapInArrow(add, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    rows = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # dim * dim rows
    full = np.zeros((out + 1, out))
    full[rows.column("i").to_numpy() + 1, rows.column("j").to_numpy()] = rows.column("v").to_numpy()
    rest, products = full[0] / n, full[1:] / n
    return (products + products.T) / 2 - np.outer(rest, rest)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps (QDWH): by QR while the weight is
    large, by Cholesky then. The matrix is scaled to a norm of 1 at most, and singular values of EPS / 4 or more converge."""
    n, one = len(a), np.eye(len(a))
    x, low = a / np.linalg.norm(a), EPS / 4
    for _ in range(12):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            inverse = np.linalg.inv(np.linalg.cholesky(one + wc * x.T @ x))
            new = wb / wc * x + (wa - wb / wc) * (x @ inverse.T) @ inverse
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if 1 - low < 4 * EPS and moved < EPS ** (1 / 3):
            break
    return x


def divided(a: np.ndarray, shift: float, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the eigenvectors above and below a shift; None if one is empty or an eigenvalue is too near to the shift."""
    n = len(a)
    moved = a - shift * np.eye(n)
    if np.linalg.norm(moved) <= EPS * scale:
        return None
    projector = (polar(moved) + np.eye(n)) / 2
    k = int(round(np.trace(projector)))
    if not 0 < k < n:
        return None
    basis = np.random.default_rng(n).standard_normal((n, k))
    for _ in range(3):
        basis, _ = np.linalg.qr(projector @ basis)
    every, _ = np.linalg.qr(basis, mode="complete")
    upper, lower = every[:, :k], every[:, k:]
    return (upper, lower) if np.linalg.norm(lower.T @ a @ upper) <= 50 * n * EPS * scale else None


def eigen(a: np.ndarray, need: int, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The `need` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns. Values that differ by
    rounding only share a space, of which any basis serves."""
    n, scale = len(a), np.linalg.norm(a) if scale is None else scale
    diagonal = np.diag(a)
    if n > 1 and np.linalg.norm(a - np.diag(diagonal)) > EPS * scale:
        mean, top = diagonal.mean(), diagonal.max()  # the mean is between the least and the largest eigenvalue
        for shift in (float(np.median(diagonal)), mean, (mean + top) / 2, mean + 1e-3 * (top - mean), mean - 1e-3 * (top - mean)):
            if parts := divided(a, shift, scale):
                upper, lower = parts
                values, vectors = eigen(upper.T @ a @ upper, need, scale)
                vectors = upper @ vectors
                if need > upper.shape[1]:
                    more, rest = eigen(lower.T @ a @ lower, need - upper.shape[1], scale)
                    values, vectors = np.append(values, more), np.hstack([vectors, lower @ rest])
                return values, vectors
    order = np.argsort(-diagonal, kind="stable")[:need]
    return diagonal[order], np.eye(n)[:, order]


class Whitener(NamedTuple):
    """n vectors were fitted, with these sums; `values` and the columns of `basis` are the components; trace: of the covariance;
    identity_error: the largest entry of the whitened fit list's covariance less the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    basis: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def known(self) -> np.ndarray:
        """Whether a component's variance is more than rounding."""
        return self.values > len(self.sums) * EPS * self.trace

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums: longs where these are surely exact, Python numbers otherwise."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
        safe = self.n * most + max((abs(s) for s in self.sums), default=0) < LONG // 2
        return x * self.n - self.sums.astype(np.int64) if safe else x.astype(object) * self.n - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(float) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the roots of the eigenvalues; NaN for a component without variance."""
        return self.centred(x) @ self.basis / np.sqrt(np.where(self.known, self.values, np.nan))


def fit(vectors: DataFrame, column: str = "embedding", components: int | None = None) -> Whitener:
    """Whitener of the usable vectors. components: how many, the largest first; all by default."""
    v = F.col(f"`{column}`")
    with temporary(vectors.sparkSession):
        once = written(vectors.where(usable(v)).select(coded(v).alias("x")).distinct())
        n, least, sums = totals(once)
        if least < len(sums):  # vectors of several lengths: equal ones but for zeros at their ends are one
            once = written(once.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(len(sums)) - F.size("x"))).alias("x")).distinct())
            n, least, sums = totals(once)
        dim = len(sums)
        need = dim if components is None else min(components, dim)
        none = Whitener(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0, None)
        if not n or not need:
            return none
        v = covariance(once, dim, n, none.centred, dim)
        values, basis = eigen(v, need)
        model = none._replace(values=values, basis=basis, trace=float(np.trace(v)))
        if not model.known.any():
            return model
        some = model._replace(values=values[model.known], basis=basis[:, model.known])
        own = covariance(once, dim, n, some.whitened, len(some.values))
        return model._replace(identity_error=float(np.abs(own - np.eye(len(own))).max()))


def apply(vectors: DataFrame, model: Whitener, column: str = "embedding", out: str = "white") -> DataFrame:
    """Rows with a usable vector and a column: struct<deviation, whitened>.

    Null vectors and vectors with null or non-finite entries go; all other rows stay, repeated ones and null ids too. A vector
    shorter than the longest counts as if it ended in zeros. deviation is the exact sum of (n * x - sums)^2, null where a
    long does not hold it; whitened has null for a component without variance. An empty table stays empty."""
    held = vectors.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("deviation long, whitened array<double>")
    def white(x: pa.Array) -> pa.Array:
        m, deviations, rows = held.value, [], []
        for some in matrices(iter([pa.RecordBatch.from_arrays([x], names=["x"])]), len(m.sums)):
            d = m.deviations(some)
            if d.dtype != object and d.size and int(np.abs(d).max()) ** 2 * d.shape[1] >= LONG:
                d = d.astype(object)
            deviations += [y if y < LONG else None for y in (d * d).sum(axis=1).tolist()]
            rows += [[None if np.isnan(y) else y for y in row] for row in m.whitened(some).tolist()]
        return pa.StructArray.from_arrays([pa.array(deviations, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["deviation", "whitened"])

    v = F.col(f"`{column}`")
    return vectors.where(usable(v)).withColumn(out, white(coded(v)))


def components(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", most: int = 4) -> DataFrame:
    """A row for each usable vector and component up to `most`: key, component (from 1), n, deviation, whitened, explained
    (share of the trace) and identity_error."""
    model = fit(vectors, column, most)
    shares = F.array(*[F.lit(float(e / model.trace) if model.trace else None).cast("double") for e in model.values]).cast("array<double>")
    rows = apply(vectors.select(F.col(f"`{key}`").alias(key), F.col(f"`{column}`").alias("vector")), model, "vector")
    return rows.select(key, "white.deviation", F.posexplode("white.whitened").alias("place", "whitened")).select(
        key,
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
