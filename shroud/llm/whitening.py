"""Embedding whitening (11): principal components by spectrum slicing.

1. A component c becomes the integer x = floor(64 * c) + 1,000,000.  The fit list is
   every distinct x-vector once (a grouped aggregate, combined map-side, so a vector
   that repeats leaves each task once).
2. Two passes over the fit list add integers: the sums S, then the products of the
   entries after the rounded mean is taken off.  Tasks add in numpy, exactly, and
   emit one row an entry; Spark adds those as decimals.  The covariance follows from
   them in whole numbers and is rounded once, so it does not depend on the order of
   rows.  Only d * (d + 1) / 2 numbers reach the driver, d being the dimension.
3. Spectrum slicing: the inertia of V - s * I, from its LDL' factors with
   Bunch-Kaufman pivots, counts the eigenvalues above s.  Bisection on these counts
   isolates each leading eigenvalue, Rayleigh quotient iteration from inside the
   interval converges cubically, and counts on both sides of the result certify its
   number; where they don't, the interval is halved and the iteration starts anew.
   Eigenvalues closer than rounding are taken as one cluster, its vectors made
   orthogonal to those found before.
4. One pass projects all rows, one over the fit list measures how far the
   covariance of the whitened vectors is from the identity.

Rows whose vector is null, empty, or holds null or non-finite entries, or entries
beyond 2^47 (whose x is no exact double), are dropped.  Where lengths differ, the
commonest is fitted (of equally common ones the smallest) and rows of others are
dropped.  Repeated rows and null ids are whitened like any other row, but the fit
list holds each x-vector once.  Components whose eigenvalue is zero to rounding do
not exist: they give no rows, so a table with one distinct vector gives none, as an
empty table does.  ``deviation`` is null where it exceeds a long.  Other columns
are not read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm.common import Scratch, project, read_table

LIMIT = float(1 << 47)
EPS = np.finfo(float).eps
BIG = pa.decimal128(38, 0)
OUT_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


# ---- eigenpairs of one symmetric matrix -------------------------------------


def count_below(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``v`` below ``shift``: negative pivots of LDL' of v - shift * I."""
    a = v - shift * np.eye(len(v))
    alpha, n, k, negative = (1 + 17**0.5) / 8, len(v), 0, 0
    while k < n:
        step, here = 1, abs(a[k, k])
        if k + 1 < n:
            col = np.abs(a[k + 1 :, k])
            r = k + 1 + int(col.argmax())
            most = col[r - k - 1]
            if here < alpha * most:
                row = np.abs(a[k:, r])
                row[r - k] = 0
                far = row.max()
                if here * far < alpha * most * most:
                    step = 1 if abs(a[r, r]) >= alpha * far else 2
                    to = k + step - 1
                    a[[to, r], k:] = a[[r, to], k:]
                    a[k:, [to, r]] = a[k:, [r, to]]
        pivot, rest = a[k : k + step, k : k + step], a[k + step :, k : k + step]
        if step == 2:
            negative += 1  # a two-by-two pivot holds one eigenvalue of either sign
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(pivot, rest.T)
        elif pivot[0, 0]:
            negative += int(pivot[0, 0] < 0)
            a[k + 1 :, k + 1 :] -= rest @ (rest.T / pivot[0, 0])
        k += step
    return negative


class Slicer:
    """Leading eigenpairs of a symmetric matrix, the counts at all shifts asked for kept."""

    def __init__(self, v: np.ndarray):
        self.v, self.d = v, len(v)
        radius = np.abs(v).sum(axis=1) - np.abs(np.diag(v))
        self.scale = float((np.abs(np.diag(v)) + radius).max())
        pad = 4 * EPS * self.scale
        self.counts = {float((np.diag(v) - radius).min()) - pad: self.d, float((np.diag(v) + radius).max()) + pad: 0}
        self.vectors: list[np.ndarray] = []
        self.values: list[float] = []

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = self.d - count_below(self.v, shift)
        return self.counts[shift]

    def interval(self, m: int) -> tuple[float, float]:
        """The closest known shifts with at least m and with fewer than m eigenvalues above them."""
        a = max(s for s, c in self.counts.items() if c >= m)
        return a, min((s for s, c in self.counts.items() if c < m and s > a), default=a)

    def is_cluster(self, a: float, b: float) -> bool:
        """Whether rounding forbids to tell the eigenvalues between a and b apart."""
        return b - a <= 2 * EPS * self.scale or not a < a + (b - a) / 2 < b

    def free(self, x: np.ndarray) -> np.ndarray:
        """The unit vector along x without its parts along the vectors found."""
        for _ in range(2):
            for u in self.vectors:
                x = x - (u @ x) * u
        return x / np.linalg.norm(x)

    def solve(self, shift: float, x: np.ndarray) -> np.ndarray:
        for nudge in (0.0, EPS, -EPS, 4 * EPS):
            try:
                y = np.linalg.solve(self.v - (shift + nudge * self.scale) * np.eye(self.d), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all():
                return y / np.abs(y).max()
        raise ArithmeticError(f"no shift near {shift} can be solved for")

    def iterate(self, m: int) -> tuple[float, np.ndarray, float] | None:
        """Rayleigh quotient iteration inside the interval of number m; None if it leaves it."""
        a, b = self.interval(m)
        x = self.free(np.cos(1.0 + np.arange(self.d)) + 1.5)
        for shift in (a + (b - a) / 2,) * 2:
            x = self.free(self.solve(shift, x))
        best = None
        for _ in range(12):
            rho = float(x @ self.v @ x)
            left = float(np.linalg.norm(self.v @ x - rho * x))
            if not a - 4 * EPS * self.scale <= rho <= b + 4 * EPS * self.scale:
                break
            if best is not None and left >= best[2]:
                break
            best = rho, x, left
            x = self.free(self.solve(rho, x))
        return best

    def pair(self, m: int) -> None:
        """Find number m (from 1) and certify it."""
        while True:
            a, b = self.interval(m)
            cluster = self.is_cluster(a, b)
            if cluster or (self.counts[a] == m and self.counts[b] == m - 1):
                found = self.iterate(m)
                if found:
                    rho, x, left = found
                    room = max(2 * left, 8 * EPS * self.scale)
                    if left <= 64 * EPS * self.scale and (cluster or self.above(rho - room) >= m > self.above(rho + room)):
                        self.values.append(rho)
                        self.vectors.append(x)
                        return
                if cluster:
                    raise ArithmeticError(f"eigenvalue {m} is not certified")
            self.above(a + (b - a) / 2)


def leading_pairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to k eigenvalues, falling, that are not zero to rounding, and their unit vectors as columns."""
    top = float(np.abs(v).max(initial=0.0))
    if not top:
        return np.zeros(0), np.zeros((len(v), 0))
    s = Slicer(v / top)
    for m in range(1, min(k, len(v)) + 1):
        if s.above(8 * len(v) * EPS * s.scale) < m:
            break
        s.pair(m)
    return np.array(s.values) * top, np.array(s.vectors).reshape(-1, len(v)).T


# ---- passes over the rows ---------------------------------------------------


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def _sums(d: int):
    """Rows (x) to (i, v): sums an entry, and the number of rows as entry d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 1)
        for batch in batches:
            if len(batch):
                x = _matrix(batch)
                # halves, so that no sum leaves 64 bits
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                part = [(int(h) << 32) + int(w) for h, w in zip(high, low)] + [len(batch)]
                total = [a + b for a, b in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(map(Decimal, total), BIG)], names=["i", "v"])

    return run


def _products(centre: list[int]):
    """Rows (x) to (i, j, v): sums of products of the centred entries, exact."""
    at = np.array(centre, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(len(at))
        total, part, bound = [0] * len(i), np.zeros(len(i), dtype=np.int64), 0
        for batch in batches:
            if not len(batch):
                continue
            y = _matrix(batch) - at
            most = int(np.abs(y).max()) ** 2 * len(batch)
            if most < 1 << 53:  # every product and sum is an exact double
                f = y.astype(np.float64)
                step = (f.T @ f)[i, j].astype(np.int64)
            else:
                o = y.astype(object)
                step = (o.T @ o)[i, j]
            if bound + most >= 1 << 62:
                total, part, bound = [a + int(b) for a, b in zip(total, part)], np.zeros(len(i), dtype=np.int64), 0
            if most >= 1 << 62:
                total = [a + int(b) for a, b in zip(total, step)]
            else:
                part, bound = part + step.astype(np.int64), bound + most
        total = [a + int(b) for a, b in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(Decimal, total), BIG)], names=["i", "j", "v"])

    return run


@dataclass
class Whitener:
    """The fitted map: x goes to (x - S / n) along the components, over the root of their eigenvalues."""

    n: int
    centre: list[int]
    rest: list[int]  # S - n * centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def apply(self, y: np.ndarray) -> np.ndarray:
        mean = np.array([r / self.n for r in self.rest])
        return (y.astype(np.float64) - mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, y: np.ndarray) -> list[int | None]:
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.rest))
        if most * most * len(self.rest) < 1 << 62:
            return ((self.n * y - np.array(self.rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) - np.array(self.rest, dtype=object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def _moments(w: Whitener):
    """Rows (x) to (i, j, v): sums of products of whitened entries; j = -1 holds plain sums."""
    at = np.array(w.centre, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        second, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            z = w.apply(_matrix(batch) - at) if len(batch) else np.zeros((0, k))
            second, first = second + z.T @ z, first + z.sum(axis=0)
        i, j = (x.ravel() for x in np.indices((k, k)))
        i, j = np.concatenate([i, np.arange(k)]), np.concatenate([j, np.full(k, -1)])
        v = np.concatenate([second.ravel(), first])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v)], names=["i", "j", "v"])

    return run


def _project(w: Whitener, error: float):
    at, k = np.array(w.centre, dtype=np.int64), len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = len(batch)
            if not size:
                continue
            y = _matrix(batch) - at
            row = pa.array(np.repeat(np.arange(size), k))
            deviation = pa.array(w.deviation(y), pa.int64())
            cols = [batch["vec_id"].take(row), pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()), pa.array(np.full(size * k, w.n)), deviation.take(row),
                    pa.array(w.apply(y).ravel()), pa.array(np.tile(w.values / w.trace, size)), pa.array(np.full(size * k, error))]
            yield pa.RecordBatch.from_arrays(cols, schema=OUT)

    return run


def grid_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, x) of the vectors that take part."""
    rows = project(rows, vec_id=F.col(f"`{vec_id}`").cast("long"), c=F.col(f"`{vector}`").cast("array<double>"))
    # abs() of a null, NaN or infinity is not below the limit
    fine = F.forall("c", lambda v: F.coalesce((F.abs(v) < LIMIT) & ~F.isnan(v), F.lit(False)))
    rows = rows.where((F.size("c") > 0) & fine)
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(v * 64).cast("long") + 1_000_000).alias("x"))


def fit(vectors: DataFrame, scratch: Scratch, components: int = 16) -> tuple[Whitener, DataFrame] | None:
    """The map fitted on the distinct vectors of rows (x), which are returned too; None if there are none."""
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return None
    d = lengths["d"]
    distinct = scratch.write(vectors.where(F.size("x") == d).select("x").distinct(), "fit")
    sums = distinct.mapInArrow(_sums(d), "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v"))
    s = [int(r["v"]) for r in sums.orderBy("i").collect()]
    n = s.pop()
    centre = [(2 * v + n) // (2 * n) for v in s]
    rest = [v - n * c for v, c in zip(s, centre)]
    products = distinct.mapInArrow(_products(centre), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    cov = np.zeros((d, d))
    for r in products.collect():  # d * (d + 1) / 2 rows
        i, j = r["i"], r["j"]
        cov[i, j] = cov[j, i] = (n * int(r["v"]) - rest[i] * rest[j]) / (n * n)
    values, vectors_ = leading_pairs(cov, components)
    return Whitener(n, centre, rest, values, vectors_, float(np.trace(cov))), distinct


def identity_error(w: Whitener, distinct: DataFrame) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    rows = distinct.mapInArrow(_moments(w), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    k = len(w.values)
    second, first = np.zeros((k, k)), np.zeros(k)
    for r in rows:
        if r["j"] < 0:
            first[r["i"]] = r["v"] / w.n
        else:
            second[r["i"], r["j"]] = r["v"] / w.n
    return float(np.abs(second - np.outer(first, first) - np.eye(k)).max(initial=0.0))


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """A row for each vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    scratch = Scratch(rows.sparkSession, "whitening")
    vectors = grid_vectors(rows, vec_id, vector)
    fitted = fit(vectors, scratch, components)
    if fitted is None or not len(fitted[0].values):
        return rows.sparkSession.createDataFrame([], OUT_DDL)
    w, distinct = fitted
    same = vectors.where(F.size("x") == len(w.centre))
    return same.mapInArrow(_project(w, identity_error(w, distinct)), OUT_DDL)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whiten(read_table(spark, sf_dir, "embeddings"))
