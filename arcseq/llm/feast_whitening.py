"""Whitening of embeddings by eigenvectors that contour integration finds.

Spark sums: counts and exact sums of the vectors, then the covariance of the centred vectors, as partial sums of tasks that
are added row of the matrix by row. The matrix has as many rows as the vectors have entries, whatever their number.

Eigenvectors (`FEAST` on that matrix): inertia counts (signs of the pivots of the shifted tridiagonal form) say how many
eigenvalues lie above a point; bisection by them cuts the spectrum's upper part into intervals of at most `HELD` eigenvalues.
For each interval, quadrature over a half circle of solves with the complex shifted covariance projects a block of vectors
onto the eigenvectors inside, and Rayleigh-Ritz extracts them, until their residuals are at rounding level. Each interval must
give as many as its inertia counts say, else the interval is asked again with a larger block, and at last an error is
raised. A last Rayleigh-Ritz step over all of them makes them orthogonal between intervals.

Whitened rows are written once; the covariance of the written values gives `identity_error`.

Left out: rows whose vector is null, holds a null or a value that is not finite, or has another length than most vectors of
the table (a covariance needs one length). A null vec_id stays null, repeated rows count as often as they occur, equal vectors
have equal results. Components whose eigenvalue is zero to rounding have no whitened values and are left out, so a table of
equal vectors, of one row or of none gives no rows. Other columns of the input are left out. An entry or a deviation beyond
64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcseq.session import stage

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues of an interval, at most (more only where they are equal to rounding).
HELD = 8
NODES = 8
ROUNDS = 30
#: Rows of a covariance that a task adds up, and partial sums that it adds at a time.
GROUP = 64
LOW = 1 << 31


def valid(table: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (length["d"] if length else 0))


def entries(column: pa.Array) -> np.ndarray:
    """Whole numbers of vectors of one length, a row each."""
    x = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))
    if (np.abs(x) >= 2.0**62).any():
        raise OverflowError("an entry does not fit in 64 bits")
    return x.astype(np.int64) + SHIFT


def sums_of(rows: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums of their entries; sums of high and low halves, so that no task's sum leaves 64 bits."""

    def add(batches):
        n, high, low = 0, 0, 0
        for b in batches:
            if len(b):
                x = entries(b.column(0))
                n, high, low = n + len(x), high + (x // LOW).sum(axis=0), low + (x % LOW).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(high), n)), pa.array(np.arange(len(high))), pa.array(high), pa.array(low)], names=["n", "i", "high", "low"]
            )

    parts = rows.select("v").mapInArrow(add, "n long, i long, high long, low long")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()  # a row per entry
    return (found[0]["n"] if found else 0), [r["high"] * LOW + r["low"] for r in found]


class Centre:
    """n and the sums, and what rows are minus the mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)  # the mean is whole + rest / n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Exact sums of (n x - S)^2."""
        y = x - self.whole
        if float(np.abs(y).max(initial=0) + 1) ** 2 * float(self.n) ** 2 * y.shape[1] < 2.0**62:
            return ((self.n * y - self.rest) ** 2).sum(axis=1)
        out = ((self.n * y.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        if (out >= 1 << 63).any():
            raise OverflowError("a deviation does not fit in 64 bits")
        return out.astype(np.int64)


def _added(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Sums of the arrays `v` by `keys`, added in the order of `order`."""

    def add(key, own):
        own = own.sort_by(order)
        total = np.stack(own["v"].combine_chunks().flatten().to_numpy().reshape(len(own), -1)).sum(axis=0)
        first = [pa.array([k.as_py()], pa.int64()) for k in key]
        return pa.Table.from_arrays([*first, pa.array([total.tolist()], pa.list_(pa.float64()))], names=[*keys, "v"])

    return parts.groupBy(*keys).applyInArrow(add, ", ".join(f"{k} long" for k in keys) + ", v array<double>")


def covariance(rows: DataFrame, column: str, centred, n: int, size: int) -> np.ndarray:
    """Covariance, divisor n, of `centred(vectors)`; a row of the matrix is added up in groups of tasks, then over groups."""

    def products(batches):
        total = np.zeros((size, size))
        for b in batches:
            if len(b):
                z = centred(b.column(0))
                total += z.T @ z
        part = TaskContext.get().partitionId()
        cells = [pa.array(np.arange(size)), pa.array(np.full(size, part)), pa.array(np.full(size, part // GROUP)), pa.array(total.tolist(), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(cells, names=["i", "part", "bundle", "v"])

    parts = rows.select(column).mapInArrow(products, "i long, part long, bundle long, v array<double>")
    total = _added(_added(parts, ["i", "bundle"], "part"), ["i"], "bundle").collect()  # a row of the matrix each
    out = np.zeros((size, size))
    for r in total:
        out[r["i"]] = r["v"]
    return (out + out.T) / (2 * n)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the tridiagonal matrix that reflections make of a symmetric one."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.sqrt(x @ x)
        if norm == 0:
            continue
        x[0] += np.copysign(norm, x[0])
        u = x / np.sqrt(x @ x)
        own = a[k + 1 :, k:]
        own -= 2 * np.outer(u, u @ own)
        both = a[k:, k + 1 :]
        both -= 2 * np.outer(both @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(diagonal: np.ndarray, off: np.ndarray, x: float) -> int:
    """Eigenvalues of the tridiagonal matrix greater than x: positive pivots of its factors when shifted by x."""
    tiny = np.finfo(float).tiny ** 0.5
    count, pivot = 0, 1.0
    for k in range(len(diagonal)):
        pivot = diagonal[k] - x - (off[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return count


def intervals(diagonal: np.ndarray, off: np.ndarray, wanted: int, held: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) of disjoint intervals from the largest eigenvalue down, that hold `wanted` or more together.

    A cut is a point between eigenvalues found by bisection; where `held` of them cannot be cut off because the next ones
    are equal to rounding, the interval takes these too."""
    reach = np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    top, bottom = float(reach.max()) * (1 + 1e-9) + 1e-300, -float(reach.max()) * 1e-9 - 1e-300
    same = 10 * len(diagonal) * np.finfo(float).eps * top
    out, high, taken = [], top, 0
    total = above(diagonal, off, bottom)
    while taken < min(wanted, total):
        want = min(taken + held, wanted, total)
        lo, hi = bottom, high  # above(lo) >= want, above(hi) <= taken < want
        for _ in range(200):
            mid = (lo + hi) / 2
            if not lo < mid < hi or hi - lo <= 4e-16 * top:
                break
            n = above(diagonal, off, mid)
            if n == want:
                lo = mid
                break
            lo, hi = (mid, hi) if n > want else (lo, mid)
        while above(diagonal, off, lo - same) > above(diagonal, off, lo):
            lo -= same
        n = above(diagonal, off, lo)
        if n > taken:
            # a point halfway to the next eigenvalue below keeps the contour away from those inside
            deep, near = bottom, lo
            for _ in range(60):
                mid = (deep + near) / 2
                if above(diagonal, off, mid) > n:
                    deep = mid
                else:
                    near = mid
            cut = (lo + near) / 2
            out.append((cut, high, n - taken))
            taken, high = n, cut
    return out


def inside(v: np.ndarray, low: float, high: float, count: int, rng, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of `v`, whose largest entry is 1, between low and high, by contour integration and
    Rayleigh-Ritz."""
    d = len(v)
    x, w = np.polynomial.legendre.leggauss(NODES)
    turn = np.pi * (1 + x) / 2  # the upper half circle; the lower one gives the conjugate
    centre, radius = (low + high) / 2, (high - low) / 2
    arc = np.exp(1j * turn)
    q = rng.standard_normal((d, min(block, d)))
    best = None
    for _ in range(ROUNDS):
        p = np.zeros_like(q)
        for z, weight in zip(arc, w, strict=True):
            solved = np.linalg.solve((centre + radius * z) * np.eye(d) - v, q)
            p += weight / 2 * np.real(radius * z * solved)
        basis, r = np.linalg.qr(p)
        values, turned = np.linalg.eigh(basis.T @ v @ basis)
        vectors = basis @ turned
        gap = np.linalg.norm(v @ vectors - vectors * values, axis=0)
        own = (values > low) & (values < high)
        sharp = own & (gap <= max(1e-8 * high, 100 * np.finfo(float).eps))
        if sharp.sum() == count:
            worst = gap[sharp].max(initial=0)
            if best is not None and worst >= best[2] / 2:
                break
            if best is None or worst < best[2]:
                best = values[sharp], vectors[:, sharp], worst
        q = vectors
    if best is None:
        return np.zeros(0), np.zeros((d, 0))
    return best[:2]


def feast(v: np.ndarray, wanted: int, held: int = HELD, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors (columns): `wanted`, or fewer where the rest are zero."""
    scale = float(np.abs(v).max(initial=0))
    if scale == 0 or not np.isfinite(scale):
        return np.zeros(0), np.zeros((len(v), 0))
    a = v / scale
    rng = np.random.default_rng(seed)
    diagonal, off = tridiagonal(a)
    found = []
    rounding = len(a) * np.finfo(float).eps * intervals(diagonal, off, 1, 1)[0][1]
    for low, high, count in intervals(diagonal, off, min(wanted, above(diagonal, off, rounding)), held):
        for factor in (2, 4, 8):
            values, vectors = inside(a, low, high, count, rng, factor * count + 4)
            if len(values) == count:
                break
        else:
            raise ArithmeticError(f"{len(values)} of {count} eigenvalues found between {low * scale} and {high * scale}")
        found.append(vectors)
    basis, _ = np.linalg.qr(np.concatenate(found, axis=1))
    values, turned = np.linalg.eigh(basis.T @ a @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], basis @ turned[:, order]
    some = values > len(a) * np.finfo(float).eps * values[0]
    return values[some] * scale, vectors[:, some]


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, for each row that takes part and component."""
    rows = valid(table)
    n, sums = sums_of(rows)
    out = "vec_id long, n long, deviation long, whitened array<double>"
    if n and sums:
        centre = Centre(n, sums)
        v = covariance(rows, "v", lambda c: centre.centred(entries(c)), n, len(sums))
        values, vectors = feast(v, components)
        trace = float(np.trace(v))
    if not n or not sums or not len(values):
        return rows.limit(0).select(
            "vec_id", F.lit(0).alias("component"), *[F.lit(0).cast("long").alias(c) for c in ("n", "deviation")], *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")]
        )
    scaled = vectors / np.sqrt(values)

    def project(batches):
        for b in batches:
            if len(b):
                x = entries(b.column(1))
                w = centre.centred(x) @ scaled
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(x), n)), pa.array(centre.deviations(x)), flat], names=["vec_id", "n", "deviation", "whitened"])

    white = stage(rows.select("vec_id", "v").mapInArrow(project, out), "whitened")
    k = len(values)
    # the mean of whitened values is zero to rounding; it is taken off all the same
    means = white.select(F.posexplode("whitened").alias("i", "w")).groupBy("i").agg(F.avg("w").alias("w")).orderBy("i").collect()  # a row per component
    mean = np.array([r["w"] for r in means])
    error = float(np.abs(covariance(white, "whitened", lambda c: c.flatten().to_numpy().reshape(len(c), -1) - mean, n, k) - np.eye(k)).max())
    shares = F.array(*[F.lit(float(e) / trace) for e in values])
    each = white.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error")
    )
