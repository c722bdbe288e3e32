"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import stored

LINKS = "u long, v long"


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a batch as stars: every node with the smallest node that the batch connects it to."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def _large_star(links: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node with the node's smallest neighbour, or itself."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Connect every smaller neighbour of a node, and the node, with the smallest of them. ``links`` has v < u."""
    least = stored(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node it reaches) of every node that has a link.

    ``links`` has the columns u and v, both long; order, repeats and links of a node to itself do not matter. Each
    round is written to the shared folder; only a count and a checksum reach the driver. A node with very many
    links is a skewed join key, which Spark splits: smallest neighbours are stored first, so both sides are plain shuffles.
    """
    links = stored(links.where("u != v").mapInArrow(local_forest, LINKS), "links")
    state = None
    while True:
        links = stored(_small_star(stored(_large_star(links).distinct(), "large")).distinct(), "stars")
        row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(row)
