"""Whitening of embeddings by the leading eigenvectors of their covariance, found by LOBPCG.

The covariance is never formed. A block of directions is multiplied by it in one distributed pass: each
task centres its rows, multiplies them with the block and back, and gives one partial product of the size
of the block. Each step takes the span of the iterate, of its residuals and of the previous directions, orthonormalises
it, multiplies it, and takes the best vectors of that span (Rayleigh-Ritz). The residual of every wanted
vector comes from the product itself and not from a recurrence; steps end when all are certified to be of the
size of rounding errors. Entries are whole numbers, so that their sums and the deviations of rows are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.batches import small_batches
from rollcall.session import materialise

#: Entries are whole numbers floor(SCALE * c) + SHIFT; entries beyond LARGEST have none and count as not finite.
SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**38
#: Vectors iterated beside the wanted ones, which makes the wanted ones converge faster; steps at most.
GUARD, STEPS = 8, 200
#: A residual, over the largest eigenvalue, that is at the size of rounding; one that is accepted once steps no longer lower it.
ROUNDING, ACCEPTED = 2e-14, 1e-9
#: Partial results that are summed by one task of the second stage.
FAN_IN = 64


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors without null or non-finite entries, as whole numbers; one row for each such row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            size = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array([len(v) if v.is_valid else 0 for v in lists])
            value = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            bad = ~(np.abs(value) <= LARGEST)
            row = np.repeat(np.arange(len(lists)), size)
            good = np.bincount(row, bad, len(lists)) == 0
            good &= (size > 0) & ~np.asarray(lists.is_null())
            x = np.floor(value[good[row]] * SCALE).astype(np.int64) + SHIFT
            ends = np.cumsum(np.append(0, size[good])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], ["vec_id", "x"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).mapInArrow(run, f"vec_id {kind}, x array<long>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _summed(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], width: int, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of partial(matrix) over all batches of rows of x: one partial sum for each task, summed in groups of
    FAN_IN until few are left. Every sum is taken in the order of the tasks."""
    kind = np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            total += partial(_matrix(batch.column(0), width))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["at", "total"])

    def join(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("at")
        total = sum(np.frombuffer(x, kind) for x in ordered["total"].to_pylist())
        return pa.table({"at": pa.array([ordered["at"][0].as_py()], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("x").mapInArrow(run, "at int, total binary")
    few = parts.groupBy(F.floor(F.col("at") / FAN_IN)).applyInArrow(join, "at int, total binary")  # one row for every FAN_IN tasks
    found = sorted((r["at"], bytes(r["total"])) for r in few.collect())
    return sum((np.frombuffer(x, kind).reshape(shape) for _, x in found), np.zeros(shape, kind))


def exact_moments(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each entry, exact."""
    at = vectors.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    rows = {r["i"]: r for r in at.collect()}  # one row for each dimension
    return (rows[0]["n"], [int(rows[i]["s"]) for i in range(width)]) if rows else (0, [])


class Centred:
    """Rows less their mean: the whole part of the mean is taken off exactly, its fraction in double precision."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], object)
        self.fraction = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; null if a long can't hold it."""
        off = x - self.whole
        largest = int(np.abs(off).max(initial=0) + 1) * self.n
        if largest**2 * x.shape[1] < 2**63:
            return (((off * self.n - self.rest.astype(np.int64)) ** 2).sum(axis=1)).tolist()
        exact = ((off.astype(object) * self.n - self.rest) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def _orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the blocks' span that begins with the first block's; what depends on what is before it is left out."""
    basis = np.empty((len(blocks[0]), 0))
    for block in blocks:
        for column in block.T:
            before = np.linalg.norm(column)
            if before == 0 or basis.shape[1] == len(column):
                continue
            v = column / before
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
            size = np.linalg.norm(v)
            if size > 1e-10:
                v = v / size
                v = v - basis @ (basis.T @ v)
                basis = np.column_stack([basis, v / np.linalg.norm(v)])
    return basis


def leading_eigenvectors(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray, float]:
    """LOBPCG for the largest eigenvalues of a symmetric operator that is only known by its products with blocks.

    Returns the eigenvalues, falling; unit vectors; and the largest residual over the largest eigenvalue. Raises
    if steps end with a residual over ACCEPTED.
    """
    block = min(width, wanted + guard)
    x = _orthonormal([np.random.default_rng(7).standard_normal((width, block))])
    residuals, previous = np.empty((width, 0)), np.empty((width, 0))
    best, stale, kept = np.inf, 0, None
    for _ in range(STEPS):
        basis = _orthonormal([x, residuals, previous])
        image = product(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:block], turn[:, ::-1][:, :block]
        new, new_image = basis @ turn, image @ turn
        residuals = new_image - new * values
        scale = max(abs(values[0]), np.finfo(float).tiny)
        off = np.linalg.norm(residuals[:, :wanted], axis=0).max() / scale
        if off < best / 2:
            stale = 0
        else:
            stale += 1
        if off < best:
            best, kept = off, (values[:wanted], new[:, :wanted])
        if best <= ROUNDING or (stale >= 4 and best <= ACCEPTED):
            break
        previous = new - x @ (x.T @ new)  # the part of the step that the iterate did not have
        x = new
    if best > ACCEPTED:
        raise RuntimeError(f"residuals end at {best:.1e} of the largest eigenvalue after {STEPS} steps")
    return *kept, best


def whiten(rows: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual: a row for each vector and component.

    Vectors that are null or empty, or hold null or non-finite entries (or any beyond LARGEST), are dropped; so are those whose
    length isn't the most frequent one (the longer of several). All others are fitted, repeated rows as
    often as they come, null ids too. With fewer dimensions than `components` there are as many components; components
    without variance (below 1e-12 of the largest) can't be whitened and have no rows, so equal vectors and single ones give
    none. An empty table gives no rows; other columns are ignored. `deviation` is null where a long can't hold it.
    `residual` is that of the eigenvectors, over the largest eigenvalue.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    with small_batches(spark):
        vectors = materialise(whole_vectors(rows, key, vector), "vectors")
        common = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        if not common:
            return spark.createDataFrame([], schema)
        width = common[0]["d"]
        vectors = vectors.where(F.size("x") == width)
        n, sums = exact_moments(vectors, width)
        centre = Centred(n, sums)

        def product(block: np.ndarray) -> np.ndarray:
            def partial(x: np.ndarray) -> np.ndarray:
                c = centre(x)
                return c.T @ (c @ block)

            return _summed(vectors, partial, width, block.shape) / n

        trace = float(_summed(vectors, lambda x: (centre(x) ** 2).sum(axis=0), width, (width,)).sum() / n)
        if trace == 0:
            return spark.createDataFrame([], schema)
        values, basis, residual = leading_eigenvectors(product, width, min(components, width))
        real = values > 1e-12 * values[0]
        values, basis = values[real], basis[:, real]
        scaled = basis / np.sqrt(values)
        mean = _summed(vectors, lambda x: (centre(x) @ scaled).sum(axis=0), width, (len(values),)) / n

        def spread(x: np.ndarray) -> np.ndarray:
            z = centre(x) @ scaled - mean
            return z.T @ z

        error = float(np.abs(_summed(vectors, spread, width, (len(values),) * 2) / n - np.eye(len(values))).max())
    k, explained = len(values), values / trace

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            ids = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(ids),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(ids), n, np.int64)),
                    pa.array(centre.deviations(x), pa.int64()).take(ids),
                    pa.array((centre(x) @ scaled).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(ids), error)),
                    pa.array(np.full(len(ids), residual)),
                ],
                [f.split()[0] for f in schema.split(", ")],
            )

    return vectors.select("vec_id", "x").mapInArrow(apply, schema)
