"""Principal components of vectors, and their picture in three axes between -1 and 1.

Each partition adds up its vectors and the products of their coordinates; these sums (dimension squared, whatever the rows) are
added before and after one exchange, and give mean and covariance. Components are found on that small matrix by power iteration
with deflation; the largest coordinate of a component is positive, so the same vectors always have the same picture. Vectors are
then projected by expressions, where they lie.

Defined results: null vectors are left out; fewer than three vectors have no picture; an axis on which all vectors agree is 0; ties and
repeated rows are projected alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Axes, steps and tolerance of the iteration, and decimals of the picture.
AXES, STEPS, TOLERANCE, DECIMALS = 3, 1000, 1e-12, 4


def moments(vectors: DataFrame, column: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of all vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
                x = np.c_[np.ones(len(x)), x]
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel())], ["cell", "total"])

    rows = vectors.where(F.col(column).isNotNull()).select(column).mapInArrow(sums, "cell long, total double")
    found = rows.groupBy("cell").agg(F.sum("total").alias("total")).toArrow()  # one number a cell
    size = round(len(found) ** 0.5)
    table = np.zeros((size, size))
    table.ravel()[found["cell"].to_numpy()] = found["total"].to_numpy()
    if not size:
        return 0, np.zeros(0), np.zeros((0, 0))
    n, mean = int(table[0, 0]), table[0, 1:] / table[0, 0]
    return n, mean, table[1:, 1:] / n - np.outer(mean, mean)


def components(covariance: np.ndarray, count: int = AXES) -> tuple[np.ndarray, np.ndarray]:
    """The first components, one a row, and their eigenvalues."""
    size = len(covariance)
    out, values = np.zeros((0, size)), []
    for _ in range(min(count, size)):
        v = np.cos(np.arange(1, size + 1))  # any start that no component is at right angles to
        for _ in range(STEPS):
            step = covariance @ v
            step -= out.T @ (out @ step)
            length = np.linalg.norm(step)
            if length < TOLERANCE * max(1e-300, np.abs(covariance).max()):
                v = step * 0
                break
            step /= length
            done = 1 - abs(step @ v / max(np.linalg.norm(v), 1e-300)) < TOLERANCE
            v = step
            if done:
                break
        v = v * (np.sign(v[np.abs(v).argmax()]) or 1)
        out, values = np.r_[out, v[None]], [*values, float(v @ covariance @ v)]
    return out, np.array(values)


def _along(column: str, mean: np.ndarray, axis: np.ndarray) -> Column:
    pairs = F.zip_with(F.col(column), F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(a)).alias("a")) for m, a in zip(mean, axis, strict=True)]), lambda x, p: (x - p["m"]) * p["a"])
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def project(vectors: DataFrame, id: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, list[float]]:
    """id, axes (centred coordinates), and the share of the variance that each axis explains."""
    n, mean, covariance = moments(vectors, column)
    if n < AXES:
        return vectors.select(id, F.array().cast("array<double>").alias("axes")).limit(0), []
    axes, values = components(covariance)
    rows = vectors.where(F.col(column).isNotNull()).select(id, F.array(*[_along(column, mean, a) for a in axes]).alias("axes"))
    whole = np.trace(covariance)
    return rows, [round(float(v / whole), DECIMALS) if whole > 0 else 0.0 for v in values]


def picture(vectors: DataFrame, id: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, list[float]]:
    """id, x, y, z between -1 and 1, and the share of the variance that each axis explains."""
    rows, explained = project(vectors, id, column)
    names = ("x", "y", "z")[: max(1, len(explained))]
    flat = rows.select(id, *[F.get("axes", F.lit(i)).alias(n) for i, n in enumerate(names)])
    ends = flat.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).first()  # two numbers an axis
    scaled = []
    for n in names:
        low, high = ends[f"min_{n}"], ends[f"max_{n}"]
        flat_axis = low is None or high <= low
        scaled.append((F.lit(0.0) if flat_axis else F.round((F.col(n) - low) / (high - low) * 2 - 1, DECIMALS)).alias(n))
    return flat.select(id, *scaled), explained
