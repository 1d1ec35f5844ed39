"""Embedding whitening: principal components of the distinct vectors, scaled to unit variance.

1. Entries become whole numbers; the fit list is each distinct vector once.  Equal vectors meet before the shuffle, so a hot vector is one row a task.
2. Counts and sums per dimension are exact whole numbers.
3. The scatter of the centred vectors is summed by block products, one matrix a task; its size depends on the dimension alone.
4. On the driver, which holds only that matrix: pivoted Cholesky, P'AP = LL', then one-sided Jacobi on the columns of L.  After it the
   squared column norms are the eigenvalues of A and the normalised columns its eigenvectors.
5. Every row is projected in Arrow batches; a last pass over the fit list measures the covariance of the whitened values.

Defined cases: rows with a null vector or a null, infinite or NaN entry are left out; a shorter vector (an empty one too) ends in zeros up to the longest;
entries beyond 2^53 / 64 count as that; components without variance are left out, so one distinct vector (or none, or an empty table) gives no rows;
equal eigenvalues stand in any order; repeated rows and null or repeated ids keep rows of their own; a deviation beyond a long is null; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.llm.exchange import stored

SCALE, SHIFT, LIMIT = 64, 1_000_000, 2.0**53
COMPONENTS = 16
BLOCK_ROWS = 2048
LONGEST = 1 << 63


def whole(vector: Column) -> Column:
    """Entries as whole numbers, ``floor(64 c)`` in double precision, without the shift; null where the vector does not count."""
    values = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(values, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(values, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))))
    return F.when(vector.isNotNull() & ~bad, scaled)


def _dense(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column as one matrix, short rows ending in zeros."""
    ends = np.asarray(column.offsets.to_numpy(), np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(ends)
    if (lengths == size).all():
        return values[ends[0] : ends[-1]].reshape(len(lengths), size)
    out = np.zeros((len(lengths), size), np.int64)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        out[i, : b - a] = values[a:b]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            yield _dense(batch.column("x").slice(a, BLOCK_ROWS), size)


def _centred(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """y - S / n, from whole numbers n y - S wherever they fit."""
    if np.abs(y).max(initial=0) < (1 << 62) // max(1, n):
        return (y * n - sums.astype(np.int64)) / n
    return np.array([[(int(v) * n - int(s)) / n for v, s in zip(row, sums, strict=True)] for row in y], np.float64).reshape(y.shape)


def _deviations(y: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    most = max(np.abs(y).max(initial=0) * n + max((abs(int(s)) for s in sums), default=0), 1)
    if int(most) ** 2 * max(1, y.shape[1]) < LONGEST:
        d = y * n - sums.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((int(v) * n - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in y]
    return [v if v < LONGEST else None for v in exact]


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (size x rank), rows in the matrix's own order, with L L' = a; stops where only rounding is left on the diagonal."""
    size = a.shape[0]
    order, lower = np.arange(size), np.zeros((size, size))
    left = a.diagonal().astype(np.float64).copy()
    floor = left.max(initial=0.0) * size * np.finfo(float).eps
    rank = 0
    while rank < size:
        pick = rank + int(np.argmax(left[order[rank:]]))
        if left[order[pick]] <= floor:
            break
        order[[rank, pick]] = order[[pick, rank]]
        p, rest = order[rank], order[rank + 1 :]
        root = np.sqrt(left[p])
        lower[p, rank] = root
        lower[rest, rank] = (a[rest, p] - lower[rest, :rank] @ lower[p, :rank]) / root
        left[rest] -= lower[rest, rank] ** 2
        rank += 1
    return lower[:, :rank]


def one_sided_jacobi(lower: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(squared norms, unit columns), falling, after plane rotations have made all columns orthogonal.

    Pairs are met in rounds of a tournament, so all rotations of a round act on columns of their own and are done at once.
    """
    u = lower.copy()
    count = u.shape[1] + u.shape[1] % 2
    tiny = np.finfo(float).eps
    seats = np.arange(count)
    for _ in range(sweeps):
        largest = 0.0
        for _ in range(max(0, count - 1)):
            p, q = seats[: count // 2], seats[count // 2 :][::-1]
            real = (p < u.shape[1]) & (q < u.shape[1])
            p, q = p[real], q[real]
            x, y = u[:, p], u[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            scale = np.sqrt(xx * yy)
            turn = np.abs(xy) > tiny * scale
            if turn.any():
                largest = max(largest, float((np.abs(xy[turn]) / scale[turn]).max()))
                tau = np.where(turn, (yy - xx) / np.where(turn, 2 * xy, 1), 0)
                t = np.where(turn, np.where(tau < 0, -1.0, 1.0) / (np.abs(tau) + np.hypot(1, tau)), 0)
                c = 1 / np.sqrt(1 + t * t)
                u[:, p], u[:, q] = c * x - c * t * y, c * t * x + c * y
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if largest <= 4 * tiny:
            break
    values = (u * u).sum(0)
    order = np.argsort(-values, kind="stable")
    values, u = values[order], u[:, order]
    u = u / np.sqrt(values)
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])]) if u.size else np.ones(u.shape[1])
    return values, u * sign


@dataclass(frozen=True)
class Whitening:
    """What a fit knows: n, sums per dimension (without the shift), eigenvalues, components, trace and the error measured."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def axes(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def _moments(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for y in _blocks(batches, size):
            n += len(y)
            step = y.sum(axis=0) if np.abs(y).max(initial=0) < 1 << 50 else y.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, step, strict=True)]
        if n:
            kinds = [pa.array([n] * size, pa.int64()), pa.array(range(size), pa.int32()), pa.array([str(v) for v in total])]
            yield pa.RecordBatch.from_arrays(kinds, names=["n", "at", "total"])

    return run


def _products(size: int, width: int, project: Callable) -> Callable:
    """One matrix a task: the sum of Z'Z over its blocks, by cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for y in _blocks(batches, size):
            z = project(y)
            total += z.T @ z
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array((i * width + j).astype(np.int32)), pa.array(total[i, j])], names=["at", "v"])

    return run


def _scatter(fit_list: DataFrame, size: int, width: int, project: Callable) -> np.ndarray:
    cells = fit_list.mapInArrow(_products(size, width, project), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width * width)
    for at, v in cells:
        out[at] = v
    out = out.reshape(width, width)
    return out + np.triu(out, 1).T


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct ``x`` of ``vectors`` (``whole``); null ones are left out; None where nothing varies."""
    fit_list = stored(vectors.select("x").filter("x is not null"))
    size = fit_list.agg(F.max(F.size("x"))).first()[0] or 0
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x")))
    fit_list = stored(fit_list.select(padded.alias("x")).distinct())
    if not size:
        return None
    moments = fit_list.mapInArrow(_moments(size), "n long, at int, total string")
    found = moments.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).collect()
    if not found:
        return None
    n = int(found[0]["n"])
    sums = np.array([int(r["s"]) for r in sorted(found, key=lambda r: r["at"])], object)
    scatter = _scatter(fit_list, size, size, lambda y: _centred(y, n, sums))
    values, units = one_sided_jacobi(pivoted_cholesky(scatter))
    keep = min(components, values.size)
    if not keep:
        return None
    values, trace = values[:keep] / n, float(np.trace(scatter)) / n
    axes = units[:, :keep] / np.sqrt(values)
    covariance = _scatter(fit_list, size, keep, lambda y: _centred(y, n, sums) @ axes) / n
    return Whitening(n, sums, values, units[:, :keep], trace, float(np.abs(covariance - np.eye(keep)).max()))


def _whitened(model: Whitening, size: int, id_type: pa.DataType) -> Callable:
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.values.size
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                y = _dense(part.column("x"), size)
                rows = len(y)
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))).cast(id_type)
                far = pa.array(_deviations(y, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
                each = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n, np.int64)), far]
                values = [pa.array((_centred(y, model.n, model.sums) @ model.axes).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, model.identity_error))]
                yield pa.RecordBatch.from_arrays([ids, *each, *values], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row of ``vectors`` (vec_id, x) with an ``x``."""
    kinds = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType())] + [(n, T.DoubleType()) for n in ("whitened", "explained", "identity_error")]
    schema = T.StructType([vectors.schema["vec_id"], *[T.StructField(n, t) for n, t in kinds]])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_type

    rows = vectors.select("vec_id", "x").filter("x is not null")
    return rows.mapInArrow(_whitened(model, model.sums.size, to_arrow_type(schema["vec_id"].dataType)), schema)
