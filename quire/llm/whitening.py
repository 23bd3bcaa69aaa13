"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Components are integers, floor(scale * c) + offset, and so are all sums, whatever their size: tasks subtract a whole number near the mean before they multiply, sum in
exact integers, and send them as limbs of 32 bits that Spark adds up. What half a unit of that centring leaves is taken off
exactly at the end, so the scatter has no rounding but its last. Its Cholesky factor with pivots (scatter = L L') has the rank of the data as columns; rotating pairs of
columns until all are orthogonal (one-sided Jacobi, many pairs at a time) gives L J = U S: column norms squared are eigenvalues, normalised columns the components. No
product of the factor with itself is formed, so small eigenvalues keep their digits.

Only numbers of dims^2 reach the driver. ``identity_error`` is measured on the whitened rows themselves, a second aggregate over the written result.

Defined cases: a row takes no part if its vector is null, empty, or holds a null or non-finite component. A null vec_id is kept. A component beyond a long counts as the
nearest long, and so does a deviation. Repeated rows count each and come back each. Vectors of different lengths are spaces of their own, each fitted to
its own rows. Components whose eigenvalue is 0 (up to rounding, ``RANK`` of the trace) don't exist: one vector, or copies of it alone, give no rows. Equal eigenvalues: any basis of
their space, the same for all rows. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import write_table
from quire.llm.topk import MOST, finite

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
LIMBS = 7  # of 32 bits: squares of longs, summed over more rows than there can be
RANK = 1e-13
SWEEPS = 60
CONVERGED = 1e-15


@dataclass
class Space:
    """The fit of all vectors of one length."""

    n: int
    sums: list[int]
    middle: list[int]  # whole numbers next to the means
    eigenvalues: np.ndarray
    components: np.ndarray  # [component, dimension]
    trace: float


def integers(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda c: c.cast("double")).alias("v"))
    near = lambda c: F.least(F.floor(c * F.lit(float(scale))).cast("long"), F.lit(MOST - offset)) + F.lit(offset)
    return rows.where(finite("v")).select("vec_id", F.transform("v", near).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows, their vectors as a matrix) for each length of vectors in a batch."""
    for batch in batches:
        lists = batch.column(column)
        flat, size = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False)
        begin = np.cumsum(size) - size
        for dims in np.unique(size).tolist():
            rows = np.flatnonzero(size == dims)
            yield batch, rows, flat[begin[rows][:, None] + np.arange(dims)]


def _exact(values: np.ndarray) -> np.ndarray:
    return values.astype(object)


def _limbs(x: int) -> list[int]:
    """An integer in two's complement, lowest limb first; the last one holds the sign."""
    return [x >> 32 * i & 0xFFFFFFFF for i in range(LIMBS - 1)] + [x >> 32 * (LIMBS - 1)]


def _added(parts: DataFrame) -> dict[tuple, int]:
    """Exact sums of the limbs by (dims, i, j), one row each."""
    sums = parts.groupBy("dims", "i", "j").agg(*[F.sum(F.col("limbs")[k]).alias(f"l{k}") for k in range(LIMBS)])
    return {(r["dims"], r["i"], r["j"]): sum(r[f"l{k}"] << 32 * k for k in range(LIMBS)) for r in sums.collect()}


_PART = pa.schema([("dims", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("limbs", pa.list_(pa.int64()))])


def _part(dims: int, cells: Iterator[tuple[int, int, int]]) -> pa.RecordBatch:
    i, j, values = zip(*cells)
    return pa.RecordBatch.from_arrays([pa.array([dims] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
            pa.array([_limbs(int(v)) for v in values], pa.list_(pa.int64()))], schema=_PART)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each length the number of rows (at i = -1) and the sum of each component."""
    totals: dict[int, np.ndarray] = {}
    for _, _, x in _matrices(batches, 0):
        n, dims = x.shape
        safe = float(np.abs(x.astype(float)).max()) * n < 1 << 62
        now = np.r_[_exact(np.array([n])), _exact(x.sum(axis=0)) if safe else _exact(x).sum(axis=0)]
        totals[dims] = totals[dims] + now if dims in totals else now
    for dims, total in totals.items():
        yield _part(dims, ((i - 1, 0, v) for i, v in enumerate(total)))


def _products(middle: dict[int, list[int]]):
    """Of each length the sums of products of components that are counted from ``middle``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for _, _, x in _matrices(batches, 0):
            n, dims = x.shape
            y = centred(x, middle[dims])
            most = float(np.abs(y.astype(float)).max()) ** 2 * n
            if most < 1 << 52:  # every partial sum is a whole number that a double holds
                z = y.astype(float)
                now = _exact((z.T @ z).astype(np.int64))
            else:
                now = _exact(y.T @ y) if most < 1 << 62 else _exact(y).T @ _exact(y)
            totals[dims] = totals[dims] + now if dims in totals else now
        for dims, total in totals.items():
            yield _part(dims, ((i, j, total[i, j]) for i in range(dims) for j in range(i + 1)))

    return run


def centred(x: np.ndarray, middle: list[int]) -> np.ndarray:
    """x - middle; as Python's integers where a long can't hold it."""
    small = float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, middle)) < 1 << 62
    return x - np.array(middle, np.int64) if small else _exact(x) - np.array(middle, object)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (rows in the order of ``a``) with a = L L', as many columns as the rank."""
    left, rest = [], a.diagonal().copy()
    enough = RANK * max(float(rest.sum()), 0.0)
    for _ in range(len(a)):
        p = int(rest.argmax())
        if not rest[p] > enough:
            break
        column = a[:, p] - sum((c * c[p] for c in left), np.zeros(len(a)))
        column /= np.sqrt(rest[p])
        left.append(column)
        rest = rest - column**2
        rest[p] = -1.0
    return np.stack(left, axis=1) if left else np.zeros((len(a), 0))


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """``factor`` times a rotation, so that its columns are orthogonal; longest first. A round turns disjoint pairs, a sweep meets all pairs."""
    x = factor.copy()
    size = x.shape[1] + x.shape[1] % 2
    ring = np.arange(size)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(max(0, size - 1)):
            p, q = ring[: size // 2], ring[size // 2 :][::-1]
            both = (p < x.shape[1]) & (q < x.shape[1])
            p, q = p[both], q[both]
            a, b = x[:, p], x[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            off = np.abs(ab) / np.maximum(np.sqrt(aa * bb), 1e-300)
            worst = max(worst, float(off.max(initial=0)))
            turn = off > CONVERGED
            half = np.where(turn, (bb - aa) / (2 * np.where(turn, ab, 1)), 0)
            t = np.where(turn, np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.hypot(1, half)), 0)
            c = 1 / np.hypot(1, t)
            x[:, p], x[:, q] = c * a - c * t * b, c * t * a + c * b
            ring = np.r_[ring[0], ring[-1:], ring[1:-1]]
        if worst <= 4 * CONVERGED:
            break
    return x[:, np.argsort(-(x * x).sum(axis=0), kind="stable")]


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """The space of each length of the vectors x."""
    only = rows.select("x")
    kind = "dims int, i int, j int, limbs array<long>"
    first = _added(only.mapInArrow(_sums, kind))
    size = {d: n for (d, i, _), n in first.items() if i < 0}
    sums = {d: [first[d, i, 0] for i in range(d)] for d in size}
    middle = {d: [(2 * s + n) // (2 * n) for s in sums[d]] for d, n in size.items()}
    second = _added(only.mapInArrow(_products(middle), kind)) if size else {}
    out = {}
    for d, n in size.items():
        left = [s - n * m for s, m in zip(sums[d], middle[d])]  # what the middle misses, times n
        scatter = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                scatter[i, j] = scatter[j, i] = (n * second[d, i, j] - left[i] * left[j]) / n  # exact but for this division
        x = one_sided_jacobi(pivoted_cholesky(scatter))
        norms, trace = (x * x).sum(axis=0), float(scatter.trace())
        x = x[:, norms > RANK * trace][:, :components]
        length = np.sqrt((x * x).sum(axis=0))
        unit = x / length
        unit *= np.where(unit[np.abs(unit).argmax(axis=0), np.arange(unit.shape[1])] < 0, -1.0, 1.0) if unit.size else 1.0
        out[d] = Space(n, sums[d], middle[d], length**2 / n, unit.T, trace / n)
    return out


def transform(rows: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """(vec_id, dims, deviation, w) of each row: w holds the whitened components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, x in _matrices(batches, 1):
            n, dims = x.shape
            space = spaces[dims]
            y, left = centred(x, space.middle), [s - space.n * m for s, m in zip(space.sums, space.middle)]
            most = space.n * (float(np.abs(y.astype(float)).max()) + 1)
            if most**2 * dims < 1 << 62:
                z = space.n * y - np.array(left, np.int64)
                deviation = (z * z).sum(axis=1)
            else:
                z = space.n * _exact(y) - np.array(left, object)
                deviation = np.array([min(MOST, v) for v in (z * z).sum(axis=1)], np.int64)
            w = (z / space.n).astype(float) @ space.components.T / np.sqrt(space.eigenvalues)
            k = w.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([dims] * n, pa.int32()), pa.array(deviation, pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(w.ravel()))], names=["vec_id", "dims", "deviation", "w"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, dims int, deviation long, w array<double>")


def identity_errors(made: DataFrame, components: int) -> dict[int, float]:
    """For each length the largest absolute entry of the covariance of w minus the identity."""
    at = [F.get("w", F.lit(i)) for i in range(components)]
    mean = made.groupBy("dims").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)])
    means = {r["dims"]: r for r in mean.collect()}  # a row for each length
    if not means:
        return {}
    centre = [c - F.element_at(F.create_map(*[x for d, r in means.items() for x in (F.lit(d), F.lit(r[f"m{i}"]).cast("double"))]), F.col("dims")) for i, c in enumerate(at)]
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    found = made.groupBy("dims").agg(*[F.avg(centre[i] * centre[j]).alias(f"c{i}_{j}") for i, j in pairs])
    return {r["dims"]: max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None), default=0.0) for r in found.collect()}


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    rows = integers(vectors)
    spaces = fit(rows, components)
    made = write_table(transform(rows, spaces), "whitened")
    errors = identity_errors(made, components)
    facts = [(d, s.n, [float(e / s.trace) for e in s.eigenvalues], errors.get(d, 0.0)) for d, s in spaces.items()]
    known = F.broadcast(vectors.sparkSession.createDataFrame(facts, "dims int, n long, shares array<double>, identity_error double"))  # a row for each length
    each = made.join(known, "dims").select("vec_id", "n", "deviation", "shares", "identity_error", F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.element_at("shares", F.col("at") + 1).alias("explained"), "identity_error")
