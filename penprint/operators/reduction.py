"""Truncated singular value decomposition of wide, sparse rows.

A block of directions, a little wider than asked for, is multiplied by the rows and back by them in every pass, and made orthogonal again; it
turns into the strongest directions. Rows stay sparse. What a task holds, and what reaches the driver, is one number for
each column and direction of the block, never a square of all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTRA = 10  # directions of the block beyond those asked for
NARROW = 1024  # columns up to which the block has them all, and one pass is exact
CELLS = 1 << 22  # numbers multiplied together


def _cells(batches: Iterator[pa.RecordBatch], place: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows at a time with the column and weight of every cell and where each row's cells start."""
    for batch in batches:
        sizes = np.array([len(v) if v is not None else 0 for v in batch.column(place)], np.int64)
        edges = np.r_[0, np.cumsum(sizes)]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + max(1, CELLS // width), "right")) - 1)
            part = batch.slice(at, end - at)
            columns, weights = (part.column(place + i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            yield part, columns.astype(np.int64), weights, edges[at:end + 1] - edges[at]
            at = end


def _products(columns: np.ndarray, weights: np.ndarray, edges: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Sparse rows times directions."""
    out = np.zeros((len(edges) - 1, directions.shape[1]))
    filled = np.flatnonzero(np.diff(edges))
    if len(filled):
        out[filled] = np.add.reduceat(weights[:, None] * directions[columns], edges[filled], axis=0)
    return out


def _there_and_back(cells: DataFrame, directions: np.ndarray) -> np.ndarray:
    """The rows' transpose times the rows times ``directions``."""
    shared = cells.sparkSession.sparkContext.broadcast(directions)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        total = np.zeros_like(block)
        touched = np.zeros(len(block), bool)
        for _, columns, weights, edges in _cells(batches, 0, block.shape[1]):
            if not len(columns):
                continue
            spread = weights[:, None] * np.repeat(_products(columns, weights, edges, block), np.diff(edges), axis=0)
            order = np.argsort(columns, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(columns[order]) != 0])
            total[columns[order][first]] += np.add.reduceat(spread[order], first, axis=0)
            touched[columns] = True
        used = np.flatnonzero(touched)
        for start in range(0, len(used), 4096):
            some = used[start:start + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["place", "sums"])

    rows = (
        cells.select("columns", "weights").mapInArrow(multiply, "place int, sums array<double>")
        .groupBy("place").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).collect()
    )
    out = np.zeros_like(directions)
    for row in rows:
        out[row["place"]] = row["sums"].toArray()
    shared.destroy()
    return out


@dataclass(frozen=True)
class SparseReduction:
    """The strongest directions, a column each, and their singular values, falling."""

    directions: np.ndarray
    values: np.ndarray

    def transform(self, cells: DataFrame, doc_id: str, name: str = "features") -> DataFrame:
        """``doc_id`` and the projection of every row; a row without cells is zero."""
        shared = cells.sparkSession.sparkContext.broadcast(self.directions)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, columns, weights, edges in _cells(batches, 1, shared.value.shape[1]):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(_products(columns, weights, edges, shared.value)), pa.list_(pa.float64()))], names=[doc_id, name])

        kind = cells.schema[doc_id].dataType.simpleString()
        return cells.select(doc_id, "columns", "weights").mapInArrow(project, f"`{doc_id}` {kind}, `{name}` array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(self.directions)], "index int, row array<double>").write.mode("overwrite").parquet(f"{path}/directions")
        spark.createDataFrame([(self.values.tolist(),)], "values array<double>").write.mode("overwrite").parquet(f"{path}/values")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SparseReduction:
        rows = spark.read.parquet(f"{path}/directions").orderBy("index").collect()
        return SparseReduction(np.array([r["row"] for r in rows]), np.array(spark.read.parquet(f"{path}/values").first()["values"]))


def fit_sparse_svd(cells: DataFrame, width: int, k: int = 100, rounds: int = 30, tolerance: float = 1e-9, seed: int = 1) -> SparseReduction:
    """The ``k`` strongest directions of rows given as ``columns`` and ``weights`` (arrays), of ``width`` columns.

    Up to ``NARROW`` columns one pass is exact. Beyond, passes go on until no singular value changes by more than ``tolerance`` of the
    largest, at most ``rounds`` times. The largest entry of every direction is positive.
    """
    size = width if width <= NARROW else min(width, k + EXTRA)
    block = np.eye(width) if size == width else np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    before = None
    for _ in range(rounds):
        image = _there_and_back(cells, block)
        squares, turn = np.linalg.eigh(block.T @ image)
        squares, turn = squares[::-1][:k], turn[:, ::-1][:, :k]
        values = np.sqrt(np.maximum(squares, 0))
        if size == width or (before is not None and np.abs(values - before).max(initial=0) <= tolerance * values.max(initial=0)):
            break
        before = values
        block = np.linalg.qr(image)[0]
    directions = block @ turn
    signs = np.sign(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])]) if directions.size else 1.0
    return SparseReduction(directions * signs, values)
