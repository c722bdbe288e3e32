"""Whitening of embeddings: principal components of the distinct vectors, scaled to unit variance.

Three passes over the distinct vectors, each returning sums of a size that only the dimension sets: exact sums, centred products, and the
covariance of the result. The components come from ``feast``; the matrix between has as many rows as a vector has components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import extended, stored
from penprint.llm.feast import largest_eigenpairs
from penprint.llm.topk import quantised

LONG = 2.0**62
ROWS = 4096  # vectors multiplied at once


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with exact ``sums``; ``components`` as rows, their ``variances``, falling, and the ``total`` variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Centred rows on the components, at unit variance."""
        return (x - self.sums / self.n) @ self.components.T / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n x - sum) squared, exact; an error where that is no long."""
        reach = float(np.abs(x).max(initial=0)) * self.n + float(np.abs(self.sums).max(initial=0))
        if reach < LONG and reach * reach * max(1, x.shape[1]) < LONG:
            return ((self.n * x - self.sums) ** 2).sum(1)
        out = [sum((self.n * int(v) - int(s)) ** 2 for v, s in zip(row, self.sums)) for row in x]
        if max(out, default=0) > np.iinfo(np.int64).max:
            raise OverflowError("a deviation is beyond the range of a long")
        return np.array(out, np.int64)


def matrices(batches: Iterator[pa.RecordBatch], place: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some rows of a batch at a time, with the vectors of column ``place`` as a matrix of ``width`` columns."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            if width:
                yield part, part.column(place).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def summed(rows: DataFrame, width: int, height: int, add: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over all vectors ``x`` of ``add(matrix of some vectors)``, an array of ``height`` rows, added up in the tasks first."""
    number = np.int64 if kind == "bigint" else np.float64

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in matrices(batches, 0, width):
            part = add(x)
            if kind == "bigint" and total is not None and float(np.abs(total).max()) + float(np.abs(part).max()) > LONG:
                raise OverflowError("a sum is beyond the range of a long")
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), pa.array(list(total.reshape(height, -1)))], names=["row", "cells"])

    cells = (
        rows.select("x").mapInArrow(partial, f"row int, cells array<{kind}>")
        .select("row", F.posexplode("cells").alias("column", "cell")).groupBy("row", "column").agg(F.sum("cell").alias("cell")).toArrow().to_pandas()
    )
    out = np.zeros((height, int(cells["column"].max()) + 1 if len(cells) else 0), number)
    out[cells["row"], cells["column"]] = cells["cell"]
    return out


def whole_vectors(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """``df`` with ``_x``, the vector in whole numbers, without rows whose vector is null, empty or holds a null or non-finite component."""
    return df.withColumn("_x", quantised(F.col(f"`{vector}`"), scale)).where(F.size("_x") > 0)


def fit(df: DataFrame, vector: str = "embedding", k: int = 4, scale: int = 256) -> Whitening:
    """Whitening along the ``k`` directions of largest variance of the distinct vectors floor(scale * component).

    Every distinct vector counts once, however often it stands in ``df``. Vectors of another length than the longest take no part. Fewer
    components are found if fewer have a variance above zero; none for less than two distinct vectors.
    """
    distinct = stored(whole_vectors(df, vector, scale).select(F.col("_x").alias("x")).distinct(), "distinct")
    width = distinct.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    rows = distinct.where(F.size("x") == width)
    n = rows.count()
    sums = summed(rows, width, 1, lambda x: x.sum(0)[None], "bigint").reshape(-1)
    if n < 2:
        return Whitening(n, sums, np.zeros((0, width)), np.zeros(0), 0.0, 0.0)
    mean = sums / n

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = summed(rows, width, width, products, "double") / n
    covariance = (covariance + covariance.T) / 2
    variances, components = largest_eigenpairs(covariance, k)
    found = Whitening(n, sums, components, variances, float(np.trace(covariance)), 0.0)
    if not len(variances):
        return found

    def squares(x: np.ndarray) -> np.ndarray:
        white = found.project(x)
        return white.T @ white

    error = np.abs(summed(rows, width, len(variances), squares, "double") / n - np.eye(len(variances))).max()
    return Whitening(n, sums, components, variances, found.total, float(error))


def transform(df: DataFrame, model: Whitening, vector: str = "embedding", carry: Sequence[str] | None = None, scale: int = 256) -> DataFrame:
    """``carry`` columns (all, by default) with ``whitened``, array of one number per component, and ``deviation``.

    Rows whose vector takes no part in ``fit`` are left out; repeated rows and null ids stay. Carried columns named
    ``whitened`` or ``deviation`` give way.
    """
    carry = [c for c in (df.columns if carry is None else carry) if c not in ("whitened", "deviation")]
    width = len(model.sums)
    rows = whole_vectors(df, vector, scale).where(F.size("_x") == width).select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)], "_x")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, len(carry), width):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(list(model.project(x)), pa.list_(pa.float64())), pa.array(model.deviations(x), pa.int64())],
                names=[*batch.schema.names[:-1], "whitened", "deviation"])

    out = rows.mapInArrow(project, extended(rows.drop("_x").schema, "whitened array<double>, deviation long"))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)], "whitened", "deviation")


def component_rows(found: DataFrame, model: Whitening, carry: Sequence[str]) -> DataFrame:
    """A row per row of ``transform`` and component, numbered from 1 by falling variance, with the share of the variance it explains."""
    explained = F.array(*[F.lit(float(v / model.total)) for v in model.variances]).cast("array<double>")
    cells = found.select(*[F.col(f"`{c}`") for c in carry], "deviation", F.posexplode("whitened").alias("_place", "_value"))
    return cells.select(
        *[F.col(f"`{c}`") for c in carry], (F.col("_place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("_value").alias("whitened"), F.get(explained, F.col("_place")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
