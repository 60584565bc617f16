"""Whitening embeddings by matrix-free block subspace iteration.

No covariance is formed: a pass over the table multiplies a block Q of orthonormal columns by the covariance of the
centred rows, XᵀXQ / n, which takes a number of rows at a time in each task, and Spark sums the tasks' parts by
dimension. The driver holds matrices of dimensions x columns only: it solves the block's own eigenvalue problem
(Rayleigh-Ritz), measures each wanted component's residual, and orthonormalises (QR) the product for the next pass,
until the residuals certify all components. Entries become whole numbers first, so that counts and sums are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

COMPONENTS = 32
#: A residual, relative to the largest eigenvalue, at which a component is certified: near what sums of doubles allow.
TOLERANCE = 1e-12
#: Passes after which an error says that the components are not certified.
MAX_PASSES = 1000
#: Columns of the block beyond the wanted components: the block converges as the next eigenvalue behind it falls away.
SPARE = 32
SEED = 11
STEP = 64
#: Entries whose whole number lies beyond this stand at it, so that sums of a batch stay exact.
_MOST = 1 << 45


class Whitening(NamedTuple):
    n: int
    sums: list[int]  # of x less 1000000, by dimension
    components: np.ndarray  # unit columns, by falling eigenvalue
    values: np.ndarray  # their eigenvalues
    trace: float
    passes: int
    identity_error: float  # 0 where there are no components

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def valid(column: Column) -> Column:
    """Whether a vector takes part: not null, and no entry null, infinite or not a number."""
    return column.isNotNull() & ~F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))


def whole(vectors: pa.Array) -> np.ndarray:
    """floor(64 c) of each entry, a row a vector: x without its offset of 1000000, which no difference sees."""
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(STEP * flat), -_MOST, _MOST).astype(np.int64).reshape(len(vectors), -1)


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose vectors have about a million entries, or one row; none is empty."""
    for batch in batches:
        entries = pc.sum(pc.list_value_length(batch.column(column))).as_py() or 0
        rows = max(1, (1 << 20) * len(batch) // max(entries, 1 << 20)) if len(batch) else 1
        yield from (batch.slice(a, rows) for a in range(0, len(batch), rows))


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
    """The sum over all batches of a table's vectors of a matrix of doubles: tasks add up their own, Spark sums by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for batch in slices(batches, 0):
            total += part(whole(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(height)), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width).cast(pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.mapInArrow(run, "i long, row array<double>").groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(width)])
    out = np.zeros((height, width))
    for row in parts.collect():  # `height` rows
        out[row[0]] = row[1:]
    return out


def counted(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(number of vectors, exact sums of their whole numbers by dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):  # its sums stay below 2^63 in slices of 10,000 rows; sums over slices are decimals
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(whole(batch.column(0)).sum(0)), pa.array(np.full(dims, len(batch)))], ["i", "sum", "n"])

    sums = rows.mapInArrow(run, "i long, sum long, n long").groupBy("i").agg(F.sum(F.col("sum").cast("decimal(38,0)")), F.sum("n")).orderBy("i").collect()
    return (sums[0][2], [int(r[1]) for r in sums]) if sums else (0, [])


def fit(vectors: DataFrame, column: str, dims: int, k: int = COMPONENTS, tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES, spare: int = SPARE) -> Whitening:
    """Mean and the first `k` components of the covariance of all vectors of `dims` entries that take part.

    There are fewer components where the covariance has no more positive eigenvalues (beyond rounding): none if all
    vectors are equal. Equal eigenvalues give any orthonormal basis of theirs.
    """
    rows = vectors.where(valid(F.col(column)) & (F.size(column) == dims)).select(F.col(column).alias("v"))
    n, sums = counted(rows, dims)
    nothing = Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0, 0, 0.0)
    if not n or not dims:
        return nothing
    mean = nothing.mean
    width = min(dims, k + spare)

    def covariance_times(block: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times a block, and its trace."""

        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return np.column_stack([centred.T @ (centred @ block), np.einsum("ij,ij->j", centred, centred)])

        out = _summed(rows, part, dims, block.shape[1] + 1) / n
        return out[:, :-1], float(out[:, -1].sum())

    block = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, width)))[0]
    passes = 0
    while True:
        product, trace = covariance_times(block)
        passes += 1
        inner = block.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = block @ turn, product @ turn
        found = min(k, int((values > values[0] * dims * np.finfo(float).eps).sum()) if values[0] > 0 else 0)
        residual = np.linalg.norm(image[:, :found] - ritz[:, :found] * values[:found], axis=0)
        if found == 0 or residual.max() <= tolerance * values[0]:
            break
        if passes >= max_passes:
            raise RuntimeError(f"{int((residual > tolerance * values[0]).sum())} of {found} components are not certified after {passes} passes; the largest residual is {residual.max() / values[0]:.3g} of the largest eigenvalue")
        block = np.linalg.qr(image)[0]
    components = ritz[:, :found] / np.linalg.norm(ritz[:, :found], axis=0)
    model = Whitening(n, sums, components, values[:found], trace, passes, 0.0)
    return model._replace(identity_error=_identity_error(rows, model)) if found else model


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    return (x - model.mean) @ (model.components / np.sqrt(model.values))


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, measured on all of them."""
    k = len(model.values)

    def part(x: np.ndarray) -> np.ndarray:
        w = projected(x, model)
        return np.vstack([w.T @ w, w.sum(0)])

    out = _summed(rows, part, k + 1, k) / model.n
    return float(np.abs(out[:-1] - np.outer(out[-1], out[-1]) - np.eye(k)).max())  # the mean is zero but for rounding


def deviations(x: np.ndarray, model: Whitening) -> list[int]:
    """Exactly, of each row, the sum over dimensions of (n x - S)²."""
    bound = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums), default=0)
    if x.shape[1] * bound * bound < 1 << 63:
        y = model.n * x - np.array(model.sums, np.int64)
        return np.einsum("ij,ij->i", y, y).tolist()
    y = model.n * x.astype(object) - np.array(model.sums, object)
    return (y * y).sum(1).tolist()


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Every vector that takes part, whitened: its key, `n`, `deviation` decimal(38,0), `whitened` array<double>, and the
    fit's `explained` array<double> and `identity_error`.

    Vectors null or empty, or with a null, infinite or undefined entry, take no part. Vectors of each length are fitted among
    themselves, in order of length. Repeated rows and null keys count as rows of their own; other columns, whatever
    their names, are not read; an empty table gives none. A fit without components gives empty arrays; a deviation
    beyond 38 digits is an error.
    """
    there = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("v"))
    lengths = sorted(r[0] for r in there.where(valid(F.col("v"))).where(F.size("v") > 0).groupBy(F.size("v")).count().limit(1001).collect())
    if len(lengths) > 1000:
        raise ValueError("vectors have over 1,000 different lengths")
    kind = there.schema["key"].dataType
    schema = f"key {kind.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"

    def of(dims: int) -> DataFrame:
        model = fit(there, "v", dims, k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                x, size = whole(batch.column(1)), len(batch)
                w = projected(x, model)
                explained = np.tile(model.values / model.trace if len(model.values) else model.values, size)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * w.shape[1]), pa.array(flat)) for flat in (w.ravel(), explained)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(size, model.n)), pa.array(map(Decimal, deviations(x, model)), pa.decimal128(38, 0)), *lists, pa.array(np.full(size, model.identity_error))], ["key", "n", "deviation", "whitened", "explained", "identity_error"])

        return there.where(valid(F.col("v")) & (F.size("v") == dims)).mapInArrow(run, schema)

    empty = vectors.sparkSession.createDataFrame([], schema)
    out = empty
    for dims in lengths:
        out = of(dims) if out is empty else out.unionByName(of(dims))
    return out.withColumnRenamed("key", key)


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(common.table(spark, sf_dir, "embeddings"))
    by_component = rows.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    return by_component.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error")
