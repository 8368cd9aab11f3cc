"""Whitening of embeddings from exact integer cross-products by bit slices.

Entries become integers. Over the fit list (each distinct vector once) every dimension is shifted to begin at
zero, and its bit planes are packed across rows into 64-bit words. The cross-product of two dimensions is the sum, over pairs
of their planes, of the number of common one bits times the planes' weights: exact, in whatever order tasks
end. Products are centred as integers, divided once, and given to ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.sources.tables import stored, table

#: Steps of one unit of an entry; components that the query returns; rows sliced together; bits of a limb of an exact sum.
SCALE, COMPONENTS, ROWS, LIMB = 256.0, 4, 1 << 13, 31


@dataclass(frozen=True)
class Whitening:
    """Size and sums of the fit list, eigenvalues by falling size, unit eigenvectors in columns, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vectors`` with ``x``, the entries as ``floor(256 * c)``; rows whose vector is null or holds null or non-finite entries go.

    Vectors must have one length: those of another than the most frequent one (of equally frequent ones the
    longest), empty ones too, lack entries or have too many and go like those with null entries.
    """
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(finite)
    length = whole.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kept = whole.where(F.size(column) == length.d) if length else whole
    return kept.withColumn("x", F.transform(column, lambda c: F.floor(c.cast("double") * SCALE)))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix of int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bit planes of the columns of ``y``, 0 or more, packed across rows into words: ``bits[d]`` rows for column ``d``, least first."""
    padded = np.zeros((sum(bits), -(-len(y) // 64) * 64), bool)
    k = 0
    for d, n in enumerate(bits):
        for p in range(n):
            padded[k, : len(y)] = (y[:, d] >> np.uint64(p)) & np.uint64(1)
            k += 1
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def scatter(y: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Common one bits of every pair of planes (lower triangle) and one bits of each, over the rows of ``y``."""
    sliced = planes(y, bits)
    common = np.zeros((len(sliced), len(sliced)), np.int64)
    for k in range(len(sliced)):
        common[k, : k + 1] = np.bitwise_count(sliced[: k + 1] & sliced[k]).sum(axis=1, dtype=np.int64)
    return common, np.bitwise_count(sliced).sum(axis=1, dtype=np.int64)


def products(common: np.ndarray, bits: list[int]) -> list[list[int]]:
    """Exact cross-products of the dimensions from the planes' common bits: sums of counts by weight."""
    full = (np.tril(common) + np.tril(common, -1).T).astype(object)
    edges = np.concatenate([[0], np.cumsum(bits)])
    weights = np.array([1 << p for n in bits for p in range(n)], object)
    full = full * weights[:, None] * weights[None, :]
    return [[sum(full[a:b, c:d].ravel().tolist(), 0) for c, d in zip(edges, edges[1:])] for a, b in zip(edges, edges[1:])]


def fitted(fit: DataFrame) -> Whitening | None:
    """The whitening of ``fit(x)``, whose vectors are distinct and of one length; ``None`` without a row.

    Counts of common bits are added up in Spark, a row of counts for each plane: their number depends on the
    dimensions and their ranges alone, and only their sums reach the driver.
    """
    ends = fit.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("d").collect()
    if not ends:
        return None
    low, bits = [r.low for r in ends], [(r.high - r.low).bit_length() for r in ends]
    shift = np.array(low, np.int64).view(np.uint64)

    def count(batches) -> Iterator[pa.RecordBatch]:
        common, ones, n = np.zeros((sum(bits), sum(bits)), np.int64), np.zeros(sum(bits), np.int64), 0
        for batch in batches:
            x = matrix(batch.column(0)).view(np.uint64)
            for at in range(0, len(x), ROWS):
                more, own = scatter(x[at : at + ROWS] - shift, bits)
                common, ones, n = common + more, ones + own, n + len(x[at : at + ROWS])
        if n:
            rows = [[n], ones, *(common[k, : k + 1] for k in range(len(common)))]
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(-2, len(common)), pa.int32()), "counts": pa.array(rows, pa.list_(pa.int64()))})

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for part in parts:
            total = total + matrix(part.column("counts")).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"k": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total], pa.list_(pa.int64()))})

    spread = fit.mapInArrow(count, "k int, counts array<long>")
    sums = {r.k: r.counts for r in spread.groupBy("k").applyInArrow(add, "k int, counts array<long>").collect()}
    n, ones = sums[-2][0], sums[-1]
    common = np.zeros((sum(bits), sum(bits)), np.int64)
    for k in range(len(common)):
        common[k, : k + 1] = sums[k]
    edges = np.concatenate([[0], np.cumsum(bits)])
    y = [sum(int(ones[k]) << int(k - a) for k in range(a, b)) for a, b in zip(edges, edges[1:])]
    centred = [[n * p - y[i] * y[j] for j, p in enumerate(row)] for i, row in enumerate(products(common, bits))]
    covariance = np.array([[c / (n * n) for c in row] for row in centred])
    values, vectors = np.linalg.eigh(covariance)
    return Whitening(n, [s + n * m for s, m in zip(y, low)], values[::-1], vectors[:, ::-1], sum(centred[i][i] for i in range(len(y))) / (n * n))


def projected(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """``rows(x, …)`` with ``deviation`` (exact; null beyond a long) and ``whitened``, an array by component.

    A component whose eigenvalue is not above the rounding error of the largest has no scale: its whitened values are zero.
    """
    n, at = model.n, rows.columns.index("x")
    scale = np.array([v**-0.5 if v > floor_of(model) else 0.0 for v in model.values[:components]])
    basis = model.vectors[:, :components] * scale
    sums = np.array(model.sums, object)
    schema = rows.drop("x").schema.add("deviation", "long").add("whitened", T.ArrayType(T.DoubleType()))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(at))
            if not len(x):
                continue
            largest = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, model.sums))
            moved = n * x - sums.astype(np.int64) if largest < 1 << 63 else n * x.astype(object) - sums
            exact = moved if largest**2 * x.shape[1] < 1 << 63 else moved.astype(object)
            squares = [int(v) if int(v) < 1 << 63 else None for v in (exact * exact).sum(axis=1)]
            white = (moved / n).astype(np.float64) @ basis
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(squares, pa.int64()), pa.array(list(white), pa.list_(pa.float64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def floor_of(model: Whitening) -> float:
    """What an eigenvalue must exceed to count as more than rounding error."""
    return max(0.0, float(model.values[0])) * len(model.values) * np.finfo(np.float64).eps


def identity_error(fit: DataFrame, model: Whitening, components: int = COMPONENTS) -> float:
    """The largest absolute entry of the covariance of the fit list's whitened vectors, less the identity, over components that have a scale."""
    scaled = [i for i, v in enumerate(model.values[:components]) if v > floor_of(model)]
    if not scaled:
        return 0.0
    white = projected(fit.select("x"), model, components).select(*(F.col("whitened")[i].alias(f"w{i}") for i in scaled))
    pairs = [(i, j) for i in scaled for j in scaled if i <= j]
    found = white.agg(*(F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each row of ``vectors(vec_id, embedding)`` that :func:`integers` keeps.

    The fit list is written once. Equal vectors count once in it and each have their rows in the result; rows without an id keep a null one.
    Where all vectors are equal, whitened and explained values are zero. Without a row to keep the result is empty.
    """
    kept = integers(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))).select("vec_id", "x")
    fit = stored(kept.select("x").distinct(), "fit")
    model = fitted(fit)
    if model is None:
        return kept.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(fit, model, components)
    shares = [float(max(0.0, v) / model.trace) if model.trace > 0 else 0.0 for v in model.values[:components]]
    rows = projected(kept, model, components).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*(F.lit(v) for v in shares))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("place")].alias("explained"), F.lit(float(error)).alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector of ``embeddings`` along the first four components; nulls, repeats and empty tables as :func:`whitened` states. Other columns are not read."""
    return whitened(table(spark, sf_dir, "embeddings"))
