"""Splits and samples by seeded hash order.

The reference orders of numeric libraries cannot be replayed on a cluster; what
is kept are the exact sizes, disjointness and determinism. Cut points are found
from a histogram of the hash, after which the split is a comparison per row: no
document is shuffled to be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions import lexicon as lx
from penprint.functions.order import first_per_group, hash_fraction, keys_at, order_key
from penprint.spec import SPLIT


def _below(key: Column, cut: str | None, past_end: bool = True) -> Column:
    return F.lit(past_end) if cut is None else key < cut


def random_split(
    df: DataFrame, doc_id: str, seed: int = 0, shares: Sequence[float] = (0.6, 0.2, 0.2), split: str = SPLIT, exact: bool = True
) -> DataFrame:
    """Train, val and test cut at ``int(train * n)`` and ``int((1 - test) * n)`` of a seeded order.

    ``exact=False`` skips the two counting passes and cuts the hash range itself.
    """
    key = order_key(seed, doc_id)
    if not exact:
        share = hash_fraction(key)
        return df.withColumn(split, F.when(share < shares[0], "train").when(share < 1 - shares[2], "val").otherwise("test"))
    n = df.count()
    keys = df.select(F.lit(0).alias("series"), key.alias("key"))
    first, second = keys_at(keys, {0: [int(shares[0] * n), int((1 - shares[2]) * n)]})[0]
    return df.withColumn(split, F.when(_below(key, first), "train").when(_below(key, second), "val").otherwise("test"))


def repeated_folds(
    df: DataFrame, doc_id: str, k: int = 10, seed: int = 0, shares: Sequence[float] = (0.6, 0.2, 0.2),
    split: str = SPLIT, prefix: str = "__split_fold_",
) -> DataFrame:
    """``k`` fold columns: train and val reshuffled and cut anew each time, test unchanged.

    This is repeated holdout, not disjoint folds. All cuts come from one pass.
    """
    pool = df.where(F.col(split).isin("train", "val"))
    cut = int(shares[0] / (shares[0] + shares[1]) * pool.count())
    folds = range(1, k + 1)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("series"), order_key(seed + i, doc_id).alias("key")) for i in folds]))
    cuts = keys_at(pool.select(each.alias("_f")).select("_f.series", "_f.key"), {i: [cut] for i in folds})
    held = F.col(split).isin("train", "val")
    return df.withColumns({
        f"{prefix}{i}": F.when(held & _below(order_key(seed + i, doc_id), cuts[i][0]), "train")
        .when(held, "val").when(F.col(split) == "test", "test")
        for i in folds
    })


def head_per_author(df: DataFrame, author: str, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` documents of each author in an order that ends in a unique column."""
    return first_per_group(df, [author], order, n, F.col(order[-1])).drop("_place")


def sample_per_author(
    df: DataFrame, author: str, doc_id: str, n: int = lx.SAMPLED_PER_AUTHOR, seed: int = 0, split: str = SPLIT
) -> DataFrame:
    """``n`` random documents per author, the first half val and the rest test.

    Authors with fewer documents yield what they have; ``short_authors`` lists them.
    """
    return (
        first_per_group(df, [author], [order_key(seed, doc_id), doc_id], n, F.col(doc_id))
        .withColumn(split, F.when(F.col("_place") <= n // 2, "val").otherwise("test")).drop("_place")
    )


def short_authors(df: DataFrame, author: str, n: int) -> DataFrame:
    return df.groupBy(author).count().where(F.col("count") < n)


def top_authors(df: DataFrame, author: str, k: int = lx.TRAIN_AUTHORS) -> DataFrame:
    """The ``k`` authors with most documents, ties by name: columns author, ``count``."""
    return df.groupBy(author).count().orderBy(F.desc("count"), author).limit(k)


def _author_plan(df: DataFrame, author: str, k: int, seed: int):
    """Top authors (at most ``k`` rows), the smallest author's count and the cut among the rest."""
    counts = df.groupBy(author).count().persist()
    top = [row[author] for row in counts.orderBy(F.desc("count"), author).limit(k).collect()]
    smallest = counts.agg(F.min("count")).first()[0] or 0
    top_df = df.sparkSession.createDataFrame([(a,) for a in top], counts.select(author).schema)
    rest = counts.join(F.broadcast(top_df), author, "left_anti")
    half = round(0.5 * rest.count())
    cut = keys_at(rest.select(F.lit(0).alias("series"), order_key(seed, author).alias("key")), {0: [half]})[0][0]
    counts.unpersist()
    return top_df, smallest, cut


def author_disjoint_split(
    df: DataFrame, author: str, order: Sequence[str], k: int = lx.TRAIN_AUTHORS, seed: int = 0,
    split: str = SPLIT, cut: bool = True,
) -> DataFrame:
    """Top ``k`` authors train; a random half of the others val, the rest test.

    With ``cut`` every author keeps as many documents as the smallest author has.
    """
    top_df, smallest, middle = _author_plan(df, author, k, seed)
    named = (
        df.join(F.broadcast(top_df.withColumn("_top", F.lit(True))), author, "left")
        .withColumn(split, F.when(F.col("_top"), "train")
                    .when(_below(order_key(seed, author), middle), "val").otherwise("test"))
        .drop("_top")
    )
    return head_per_author(named, author, order, smallest) if cut else named


def author_attribution_split(
    df: DataFrame, author: str, doc_id: str, order: Sequence[str], k: int = lx.TRAIN_AUTHORS, n: int = lx.SAMPLED_PER_AUTHOR,
    seed: int = 0, split: str = SPLIT,
) -> DataFrame:
    """Train as in ``author_disjoint_split``; val and test sampled from the same authors' other documents.

    ``order`` must end in a unique column. Each author's training documents are
    described by the last of them, so the others are found by a comparison
    with at most ``k`` broadcast rows instead of an anti join.
    """
    top_df, smallest, _ = _author_plan(df, author, k, seed)
    documents = df.join(F.broadcast(top_df), author)
    place = F.struct(*order)
    last = (
        head_per_author(documents.select(author, *[c for c in order if c != author]), author, order, smallest)
        .groupBy(author).agg(F.max(place).alias("_last"))
    )
    marked = documents.join(F.broadcast(last), author).withColumn("_train", place <= F.col("_last")).drop("_last")
    train = marked.where("_train").drop("_train").withColumn(split, F.lit("train"))
    return train.unionByName(sample_per_author(marked.where(~F.col("_train")).drop("_train"), author, doc_id, n, seed, split))


def predefined_split_index(split: Column) -> Column:
    """-1 for training rows, 0 for the rows of the one validation fold."""
    return F.when(split == "train", -1).otherwise(0)


def train_and_val(df: DataFrame, split: str = SPLIT) -> DataFrame:
    """The rows used for a final fit."""
    return df.where(F.col(split).isin("train", "val"))


def labels_in_every_split(df: DataFrame, column: str, split: str = SPLIT) -> DataFrame:
    """Values present in train and val and test: a leak when the column names authors."""
    return (
        df.where(F.col(split).isin("train", "val", "test")).select(column, split).distinct()
        .groupBy(column).count().where(F.col("count") == 3).select(column)
    )


def id_difference(left: DataFrame, right: DataFrame, doc_id: str) -> DataFrame:
    """Ids of ``left`` that ``right`` does not have."""
    return left.select(doc_id).distinct().join(right.select(doc_id), doc_id, "left_anti")
