"""Exact inner-product search with ball trees, branch and bound.

Candidates are dealt over shards; each shard is a ball tree. The inner product of a query with any vector of a
ball is at most that with its centre plus radius times the query's norm. Trees are built once and stored. A block of queries descends a tree together: balls whose bound lies
below a query's current kth score are cut, and the leaves that remain are visited in order of their bound, highest first,
while the kth score rises. Scores found in one shard go with the query to the next.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.llm.common import new_path, stored

LEAF = 128
SHARD_ROWS = 8192
BLOCK = 2048  # queries searched at once
EXACT = 2**53
LOWEST = -(2**62)  # below any score; its negative is a number too


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; null if the vector is null or holds a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


@dataclass
class BallTree:
    """Nodes by number, children after their parent; a node without children is a leaf, rows ``first`` to ``end``."""

    ids: np.ndarray
    vectors: np.ndarray  # int64, in leaf order
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray  # first of two children, -1 for leaves
    first: np.ndarray
    end: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> BallTree:
        points = vectors.astype(float)
        order = np.arange(len(ids))
        centre, radius, child, first, end = [], [], [], [], []
        todo = [(0, len(ids))]
        at = 0
        while at < len(todo):
            a, b = todo[at]
            own = points[order[a:b]]
            middle = own.mean(0)
            away = np.sqrt(((own - middle) ** 2).sum(1))
            centre.append(middle)
            radius.append(away.max())
            first.append(a)
            end.append(b)
            if b - a > LEAF and radius[-1] > 0:
                # Split halfway along the line through two far points.
                one = own[away.argmax()]
                two = own[((own - one) ** 2).sum(1).argmax()]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own @ (two - one), half)]
                child.append(len(todo))
                todo += [(a, a + half), (a + half, b)]
            else:
                child.append(-1)
            at += 1
        return cls(ids[order], vectors[order], np.array(centre), np.array(radius), np.array(child), np.array(first), np.array(end))


class BestOf:
    """The k best of each query so far: score, then smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k = k
        self.score = np.full((queries, k), LOWEST)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = floor  # scores below cannot matter

    def kth(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def offer(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of candidates ``ids`` (columns) for the queries ``which`` (rows)."""
        all_scores = np.concatenate([self.score[which], score], axis=1)
        all_ids = np.concatenate([self.id[which], np.broadcast_to(ids, score.shape)], axis=1)
        if all_scores.shape[1] > 4 * self.k:  # only those that reach the kth score need sorting
            reach = -np.partition(-all_scores, self.k - 1, axis=1)[:, self.k - 1]
            most = int((all_scores >= reach[:, None]).sum(1).max())
            if most < all_scores.shape[1]:
                keep = np.argsort(-all_scores, axis=1, kind="stable")[:, :most]
                all_scores, all_ids = np.take_along_axis(all_scores, keep, 1), np.take_along_axis(all_ids, keep, 1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :self.k]
        self.score[which] = np.take_along_axis(all_scores, order, 1)
        self.id[which] = np.take_along_axis(all_ids, order, 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows, in floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2.0**61:
        return a @ b.T
    raise OverflowError("scores do not fit into 64 bits")


def search(tree: BallTree, query_ids: np.ndarray, queries: np.ndarray, best: BestOf) -> None:
    """Offer every candidate of the tree that may be among a query's best. A query's own id is passed over."""
    as_float = queries.astype(float)
    norm = np.sqrt((as_float**2).sum(1))
    inner = np.abs(as_float).sum(1).max(initial=0) * max(1.0, np.abs(tree.centre).max(initial=0))
    slack = 1e-9 * inner + 1e-3  # rounding of the bounds; scores are whole numbers

    def bounds(which: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", as_float[which], tree.centre[node]) + norm[which] * tree.radius[node] + slack

    which, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
    leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(which):
        reach = bounds(which, node)
        alive = reach >= best.kth()[which]
        which, node, reach = which[alive], node[alive], reach[alive]
        leaf = tree.child[node] < 0
        leaves.append((which[leaf], node[leaf], reach[leaf]))
        down, below = which[~leaf], tree.child[node[~leaf]]
        which, node = np.r_[down, down], np.r_[below, below + 1]
    which, node, reach = (np.concatenate(x) for x in zip(*leaves))
    order = np.lexsort((-reach, which))
    which, node, reach = which[order], node[order], reach[order]
    turn = np.arange(len(which)) - np.searchsorted(which, which)  # a query's leaves, highest bound first
    for visit in range(int(turn.max(initial=-1)) + 1):
        now = np.flatnonzero(turn == visit)
        now = now[reach[now] >= best.kth()[which[now]]]
        if not len(now):
            break
        now = now[np.argsort(node[now], kind="stable")]
        edges = np.flatnonzero(np.diff(node[now])) + 1
        for part in np.split(now, edges):
            a, b = tree.first[node[part[0]]], tree.end[node[part[0]]]
            asked = which[part]
            score = products(queries[asked], tree.vectors[a:b])
            score[query_ids[asked][:, None] == tree.ids[None, a:b]] = LOWEST
            best.offer(asked, score, tree.ids[a:b])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.int64) if len(column) else np.empty((0, 0), np.int64)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` highest integer inner products of every query row, ties to smaller ids: query_id, rank, vec_id, score.

    ``queries`` selects the query rows; every row with another id is a candidate. Vectors that are null, empty or hold a null or non-finite
    component take no part; vectors of different lengths are not compared. A query id that repeats is asked once, with its
    smallest vector; repeated candidates all count. No candidates, no rows. Components are ``floor(scale * x)``.

    Queries are taken in blocks of about ``BLOCK``, so that what is broadcast stays bounded. The first shard is
    searched first; the kth scores found there go to all others with the block.
    """
    spark = vectors.sparkSession
    rows = stored(
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(embedding), scale).alias("vector"), queries.alias("asked"))
        .where("vec_id IS NOT NULL AND size(vector) > 0"), "vectors")
    found = [top_k_of_length(rows.where(F.size("vector") == row["length"]).drop("length"), row["count"], k)
             for row in rows.groupBy(F.size("vector").alias("length")).count().collect()]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    result = found[0]
    for more in found[1:]:
        result = result.unionAll(more)
    # A query id with vectors of several lengths is asked with each; the best of all count.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return result.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_of_length(rows: DataFrame, count: int, k: int) -> DataFrame:
    """``top_k`` for vectors of one length; per shard and query up to ``k`` rows."""
    spark = rows.sparkSession
    shards = -(-count // SHARD_ROWS)
    dealt = stored(
        rows.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id", "vector", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))
        .repartition(shards, "shard").sortWithinPartitions("shard"), "shards")
    asked = stored(rows.where("asked").groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    blocks = -(-asked.count() // BLOCK)
    trees = stored(dealt.select("shard", "vec_id", "vector").mapInArrow(build_trees, "shard int, tree binary"), "trees")
    schema = "query_id long, vec_id long, score long"
    path = new_path(spark, "scores")
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        ids, matrix = part.column("vec_id").to_numpy(), _matrix(part.column("vector").combine_chunks())
        floor = np.full(len(ids), LOWEST)
        for step, here in (("first", F.col("shard") == 0), ("rest", F.col("shard") != 0)):
            shared = spark.sparkContext.broadcast((ids, matrix, floor))

            def search_trees(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                query_ids, asked_vectors, least = shared.value
                best = BestOf(len(query_ids), k, least)  # kept over the trees of a task
                for batch in batches:
                    for tree in batch.column(0):
                        search(pickle.loads(tree.as_buffer()), query_ids, asked_vectors, best)
                row, column = np.nonzero(best.score > LOWEST)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[row]), pa.array(best.id[row, column]), pa.array(best.score[row, column])], names=["query_id", "vec_id", "score"])

            place = f"{path}/block={block}/step={step}"
            trees.where(here).select("tree").mapInArrow(search_trees, schema).write.parquet(place)
            shared.destroy()
            if step == "first":
                scores = spark.read.schema(schema).parquet(place)
                kth = scores.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).toArrow()
                at = {q: i for i, q in enumerate(ids.tolist())}
                for query, score in zip(kth.column("query_id").to_pylist(), kth.column("kth").to_pylist()):
                    floor[at[query]] = score
    # One table, whatever the number of blocks.
    return spark.read.schema(schema).parquet(path).select("query_id", "vec_id", "score") if blocks else spark.createDataFrame([], schema)


def build_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A ball tree for each shard, or for each ``SHARD_ROWS`` rows of one."""
    for shard, names, points in _shards(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([pickle.dumps(BallTree.build(names, points))], pa.binary())], names=["shard", "tree"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids and vectors of at most ``SHARD_ROWS`` rows of a shard at a time, shards one after another."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    current: int | None = None

    def whole() -> tuple[int, np.ndarray, np.ndarray]:
        return current, *(np.concatenate(x) for x in zip(*held))

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), batch.num_rows]
        for first, end in zip(edges, edges[1:]):
            for start in range(first, end, SHARD_ROWS):
                if held and (shards[start] != current or size >= SHARD_ROWS):
                    yield whole()
                    held, size = [], 0
                current = int(shards[start])
                part = batch.slice(start, min(SHARD_ROWS, end - start))
                held.append((part.column("vec_id").to_numpy(), _matrix(part.column("vector"))))
                size += part.num_rows
    if held:
        yield whole()
