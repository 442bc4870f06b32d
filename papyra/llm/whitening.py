"""Embedding whitening from a bit-sliced scatter matrix.

Each entry c becomes the integer x = floor(scale * c) + shift. The fit list is
each distinct x vector once. Tasks shift every dimension by its smallest value, cut
the rest into bit planes and pack each plane, 64 rows a word; the popcount of the AND
of two planes, weighted by both bits' values, summed, is the exact cross-product of
two dimensions, and a plane of ones gives the sums. Tasks send the popcounts summed by
(dimension pair, weight); the driver gets a number for each of these (d * d / 2 pairs x
at most 128 weights, whatever the number of rows) and puts n * sum(x y) - sum(x) sum(y)
together as Python integers: the covariance, centred exactly, times n squared. Its
eigenvectors whiten all rows in one map; whitened covariances are sums over the fit list.

Entries beyond 2 ** 60 in size are taken as that bound. Where the eigenvalues span
many orders of magnitude, Jacobi rotations in extended precision replace ``eigh``, and
the exact rank says how many components have variance.

Cases: rows whose vector is null or holds null or non-finite entries are left out;
rows with a null id and repeated rows stay and are whitened one by one; vectors of
each width are fitted apart (empty ones have no components); components without
variance have no whitened value and are left out (all of them when one distinct
vector is left); ``deviation`` is null where it exceeds a long; an empty
table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import Staged

BOUND = 1 << 60
PLANE_ROWS = 1 << 15        # rows whose planes are packed at a time
WIDE = 1e-7                 # smaller eigenvalues, as a share of the largest, are computed by rotations
PRIME = (1 << 61) - 1
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantized(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, dim, x array<long>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    edge = F.lit(float(BOUND))

    def whole(c):
        y = F.floor(F.greatest(F.least(F.lit(float(scale)) * c, edge), -edge))
        return y.cast("long") + F.lit(shift).cast("long")
    return vectors.where(F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.size(v).alias("dim"), F.transform(v, whole).alias("x"))


def matrix(column, dim: int) -> np.ndarray:
    import pyarrow as pa

    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def planes(x: np.ndarray, low: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes of the shifted rows, dimension by dimension, low bit first, and a
    plane of ones last; 64 rows a word."""
    y = (x - low).view(np.uint64)
    n = len(x)
    out = np.zeros((int(bits.sum()) + 1, -(-n // 64) * 8), np.uint8)
    filled, p = -(-n // 8), 0
    for i, width in enumerate(bits.tolist()):
        for b in range(width):
            out[p, :filled] = np.packbits((y[:, i] & np.uint64(1 << b)) != 0, bitorder="little")
            p += 1
    out[p, :filled] = np.packbits(np.ones(n, bool), bitorder="little")
    return out.view(np.uint64)


def popcounts(words: np.ndarray) -> np.ndarray:
    """Ones in the AND of each two planes (upper triangle)."""
    out = np.zeros((len(words), len(words)), np.int64)
    for p in range(len(words)):
        out[p, p:] = np.bitwise_count(words[p:] & words[p]).sum(axis=1, dtype=np.int64)
    return out


def layout(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and weight exponent of each plane; the plane of ones is dimension d."""
    dims = np.concatenate([np.repeat(np.arange(len(bits)), bits), [len(bits)]])
    exps = np.concatenate([*(np.arange(w) for w in bits), [0]])
    return dims, exps.astype(np.int64)


def by_weight(counts: np.ndarray, bits: np.ndarray) -> dict[str, np.ndarray]:
    """The popcounts summed by (dimension pair, weight exponent)."""
    dims, exps = layout(bits)
    p, q = np.triu_indices(len(dims))
    d, top = len(bits) + 1, 2 * int(bits.max(initial=0)) + 1
    # a product of two planes of one dimension counts twice unless they are the same
    times = np.where((dims[p] == dims[q]) & (p != q), 2, 1)
    key = (dims[p] * d + dims[q]) * top + exps[p] + exps[q]
    total = np.zeros(d * d * top, np.int64)
    np.add.at(total, key, counts[p, q] * times)
    at = np.flatnonzero(total)
    return {"i": at // top // d, "j": at // top % d, "s": at % top, "ones": total[at]}


def _batches(batches, dim: int, block: int = PLANE_ROWS):
    """Matrices of ``block`` rows from Arrow batches (the last may be smaller)."""
    held, size = [], 0
    for b in batches:
        x = matrix(b.column(0), dim)
        while len(x):
            take, x = x[:block - size], x[block - size:]
            held.append(take)
            size += len(take)
            if size == block:
                yield np.concatenate(held)
                held, size = [], 0
    if size:
        yield np.concatenate(held)


def scatter(fit: DataFrame, dim: int, low: np.ndarray, bits: np.ndarray) -> DataFrame:
    """(i, j, s, ones): popcounts by pair of dimensions and weight exponent."""
    def run(batches):
        import pyarrow as pa

        total = None
        for x in _batches(batches, dim):
            got = popcounts(planes(x, low, bits))
            total = got if total is None else total + got
        if total is not None:
            cols = by_weight(total, bits)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols.values()], names=list(cols))
    return fit.select("x").mapInArrow(run, "i long, j long, s long, ones long").groupBy("i", "j", "s") \
        .agg(F.sum("ones").alias("ones"))


class Fit:
    """Whitening map of one width: n, exact sums, eigenvectors and eigenvalues."""

    def __init__(self, dim: int, low: list[int], rows, components: int):
        cross = [[0] * (dim + 1) for _ in range(dim + 1)]
        for i, j, s, ones in rows:
            cross[i][j] += ones << s
        self.dim, self.low, self.n = dim, low, cross[dim][dim]
        shifted = [cross[i][dim] for i in range(dim)]
        self.sums = [shifted[i] + self.n * low[i] for i in range(dim)]
        self.shifted = shifted
        central = np.empty((dim, dim), np.longdouble)
        for i in range(dim):
            for j in range(i, dim):
                exact = self.n * cross[i][j] - shifted[i] * shifted[j]      # n ** 2 times the covariance
                central[i, j] = central[j, i] = _ratio(exact, self.n * self.n)
        values, vectors = np.linalg.eigh(central.astype(np.float64))
        rank = dim
        if values[0] < WIDE * values[-1] or values[-1] == 0:
            exact = [[self.n * cross[min(i, j)][max(i, j)] - shifted[i] * shifted[j] for j in range(dim)] for i in range(dim)]
            rank = rank_of(exact)
            values, vectors = jacobi(central)
        order = np.argsort(-values, kind="stable")
        total = float(sum(central[i, i] for i in range(dim)))
        keep = [i for i in order[:min(components, rank)] if values[i] > 0]
        self.values = np.array([float(values[i]) for i in keep])
        self.map = np.array(vectors, np.float64)[:, keep] / np.sqrt(self.values) if keep else np.zeros((dim, 0))
        self.explained = self.values / total if keep else self.values

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """(x - S / n) as doubles, and the exact sum of (n * x - S) ** 2 of each row."""
        low = np.array(self.low, np.int64)
        y = x - low
        largest = max(int(y.max(initial=0)), *(-(-s // self.n) for s in self.shifted), 1)
        if self.n * largest < (1 << 62):
            off = y * np.int64(self.n) - np.array(self.shifted, np.int64)
            peak = int(np.abs(off).max(initial=0))
            if peak * peak * self.dim < (1 << 63):
                return off / self.n, (off * off).sum(axis=1).tolist()
            dev = off / self.n
        else:
            off = y.astype(object) * self.n - np.array(self.shifted, object)
            dev = np.array([[_ratio(v, self.n) for v in row] for row in off], np.float64).reshape(y.shape)
        about = (off.astype(np.float64) ** 2).sum(axis=1)
        exact = [sum(int(v) ** 2 for v in row) if a < 1e19 else None for a, row in zip(about, off)]
        return dev, [v if v is not None and v < (1 << 63) else None for v in exact]


def _ratio(a: int, b: int) -> np.longdouble:
    """a / b in extended precision, whatever the size of the integers."""
    cut = max(abs(a).bit_length() - 62, 0)
    shift = max(b.bit_length() - 62, 0)
    if not cut and not shift:
        return np.longdouble(a) / np.longdouble(b)
    head = (abs(a) << 64) // b
    drop = max(head.bit_length() - 63, 0)
    out = np.ldexp(np.longdouble(head >> drop), drop - 64)
    return -out if a < 0 else out


def rank_of(rows: list[list[int]]) -> int:
    """Rank of an integer matrix, by elimination modulo a large prime."""
    left, rank = [np.array([v % PRIME for v in r], object) for r in rows], 0
    for col in range(len(rows)):
        pivot = next((r for r in range(rank, len(left)) if left[r][col]), None)
        if pivot is None:
            continue
        left[rank], left[pivot] = left[pivot], left[rank]
        inverse = pow(int(left[rank][col]), -1, PRIME)
        for r in range(rank + 1, len(left)):
            if left[r][col]:
                left[r] = (left[r] - left[rank] * (left[r][col] * inverse % PRIME)) % PRIME
        rank += 1
    return rank


def jacobi(a: np.ndarray, sweeps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a symmetric matrix by cyclic rotations, which keep
    the small ones of a graded matrix to relative precision."""
    a, d = a.astype(np.longdouble).copy(), len(a)
    v = np.eye(d, dtype=np.longdouble)
    for _ in range(sweeps):
        rotated = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                if a[p, q] == 0 or abs(a[p, q]) <= 1e-20 * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                rotated = True
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1 if theta >= 0 else -1) / (abs(theta) + np.sqrt(theta * theta + 1))
                c = 1 / np.sqrt(t * t + 1)
                s = t * c
                for m in (a, a.T, v):
                    x, y = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * x - s * y, s * x + c * y
                a[p, q] = a[q, p] = 0
        if not rotated:
            break
    return np.diag(a).copy(), v


def _fit(fit: DataFrame, dim: int, components: int) -> Fit:
    edge = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.min("c"), F.max("c")).collect()
    low = [0] * dim
    bits = np.zeros(dim, np.int64)
    for i, a, b in edge:
        low[i], bits[i] = a, (b - a).bit_length()
    counts = scatter(fit, dim, np.array(low, np.int64), bits).collect()
    return Fit(dim, low, [(r.i, r.j, r.s, r.ones) for r in counts], components)


def identity_error(fit_rows: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity:
    the means are subtracted first, products are summed in a second pass."""
    k = len(fit.values)
    if not k:
        return 0.0

    def sums(center):
        def run(batches):
            import pyarrow as pa

            total = np.zeros((k, k) if center is not None else k)
            for x in _batches(batches, fit.dim, 8192):
                w = fit.deviations(x)[0] @ fit.map
                total += w.sum(axis=0) if center is None else (w - center).T @ (w - center)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel())],
                                             names=["at", "v"])
        out = np.zeros(k * k if center is not None else k)
        for at, v in fit_rows.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v")).collect():
            out[at] = v
        return out / fit.n
    center = sums(None)
    return float(np.abs(sums(center).reshape(k, k) - np.eye(k)).max())


def whitened_rows(rows: DataFrame, fit: Fit, error: float) -> DataFrame:
    """A row for each vector and component."""
    k = len(fit.values)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                dev, exact = fit.deviations(matrix(part.column(1), fit.dim))
                w, m = dev @ fit.map, part.num_rows
                rep = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(rep)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fit.n, np.int64)), pa.array(exact, pa.int64()).take(pa.array(rep)),
                    pa.array(w.ravel()), pa.array(np.tile(fit.explained, m)), pa.array(np.full(m * k, error))],
                    names=[c.split()[0] for c in OUT.split(", ")])
    return rows.select("vec_id", "x").mapInArrow(run, OUT)


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)."""
    rows = Staged(quantized(vectors, scale, shift), "whiten-rows").df
    distinct = Staged(rows.where(F.col("dim") > 0).select("dim", "x").distinct(), "whiten-fit").df
    out = []
    for dim in sorted(r.dim for r in distinct.select("dim").distinct().collect()):
        mine, fit_rows = rows.where(F.col("dim") == dim), distinct.where(F.col("dim") == dim)
        fit = _fit(fit_rows, dim, components)
        if len(fit.values):
            out.append(whitened_rows(mine, fit, identity_error(fit_rows, fit)))
    return reduce(DataFrame.unionByName, out) if out else vectors.sparkSession.createDataFrame([], OUT)
