"""How filters interact: what every order of them removes at every step.

A document's failures are a mask of filters, and only counts of masks are needed. In the lexicographic list of all orders, those that
start with the same letters are an interval, whose place follows from the Lehmer code of these letters. A document is removed where the first
filter that it fails stands, behind filters that it passes: for a mask, some intervals per step. Its
counts are added at the start of each and taken off at the end, and a running sum over the ranks gives what each order removes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.llm.common import stored

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST = 7  # filters whose orders are listed
COUNTS = ("n", "good", "toxic")


def rank_of(prefix: Sequence[int], filters: int) -> int:
    """Place of the first order that starts with ``prefix``, by its Lehmer code."""
    rank, free = 0, list(range(filters))
    for place, which in enumerate(prefix):
        rank += free.index(which) * factorial(filters - 1 - place)
        free.remove(which)
    return rank


def intervals(filters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, start, end): ranks of the orders that remove documents of a mask at a step, counted from 1."""
    out = []
    for mask in range(1, 1 << filters):
        fails = [f for f in range(filters) if mask >> f & 1]
        passes = [f for f in range(filters) if not mask >> f & 1]
        for before in range(len(passes) + 1):
            for prefix in permutations(passes, before):
                for which in fails:
                    start = rank_of([*prefix, which], filters)
                    out.append((mask, before + 1, start, start + factorial(filters - 1 - before)))
    return out


def quality_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions that look at one text: few words, repeated words, capitals, odd signs. Words are cut at ASCII white space."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    size = F.char_length(text)
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (size - F.char_length(F.translate(text, CAPITALS, ""))) > 2 * size,
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(
    docs: DataFrame, conditions: Mapping[str, Column], copies: str | None = "E", doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """``doc_id``, ``part`` and ``mask`` of every row: bit i is set if the i-th condition holds; that of copies comes last.

    A row is a copy if its text is that of a smaller id anywhere in the table; null texts are empty. A null id is neither
    smaller nor larger than any, and rows of the smallest id are no copies of each other. A null part is the empty string.
    Texts meet by their SHA-256; equal ones are combined before they are shuffled, and the smallest ids are stored, so
    that a text which very many rows have is a skewed key of a plain join.
    """
    if doc_id not in docs.columns or text not in docs.columns or part not in docs.columns:
        raise ValueError(f"the documents need the columns {doc_id}, {text} and {part}")
    bits = sum((F.when(holds, 1 << i).otherwise(0) for i, holds in enumerate(conditions.values())), F.lit(0))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), bits.alias("mask"),
        *([F.sha2(F.encode(whole, "UTF-8"), 256).alias("digest")] if copies else []))
    if not copies:
        return rows
    rows = stored(rows, "masks")
    first = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copied")
    copied = F.when(F.col("doc_id") > F.col("first"), 1 << len(conditions)).otherwise(0)
    return rows.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + copied).alias("mask"))


def audit(masks: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per part, order and step of filters called ``names`` (one letter each, bit by bit), zeros included.

    ``masks`` has the columns part, mask, n, good and toxic: counts of documents, several rows of a part and mask add up. Returned are
    ``part``, ``filter_order``, ``step``, and counts within the part: ``kept`` after the step, ``removed`` at it, ``redundant`` (fail its
    filter, gone before), ``unique_fails`` (fail its filter alone), ``good_lost`` and ``toxic_lost`` (removed here) and ``shapley`` (removed by its filter
    in all orders together). No masks give no rows.
    """
    filters = len(names)
    if not 1 <= filters <= MOST:
        raise ValueError(f"between 1 and {MOST} filters have orders that can be listed")
    spark = masks.sparkSession
    counts = stored(masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS]), "mask-counts")
    # The intervals and orders are fixed by the number of filters, at most a few ten thousand rows.
    steps = F.broadcast(spark.createDataFrame(intervals(filters), "mask int, step int, start int, end int"))
    ends = F.explode(F.array(F.struct(F.col("start").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign"))))
    changes = (
        counts.join(steps, "mask").select("part", "step", *COUNTS, ends.alias("at"))
        .groupBy("part", "step", "at.rank").agg(*[F.sum(F.col(c) * F.col("at.sign")).alias(c) for c in COUNTS])
    )
    letters = [(f, i) for i, f in enumerate(names)]
    fails = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)).alias(f"fails_{i}") for _, i in letters],
        *[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"alone_{i}") for _, i in letters])
    per_filter = fails.select(
        "part", "total", F.array(*[f"fails_{i}" for _, i in letters]).alias("fails"), F.array(*[f"alone_{i}" for _, i in letters]).alias("alone"))
    orders = F.array(*[F.lit("".join(order)) for order in permutations(names)])
    grid = (
        per_filter.select("*", F.posexplode(orders).alias("rank", "filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(filters))).alias("step"))
        .withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    )
    running = Window.partitionBy("part", "step").orderBy("rank")
    so_far = Window.partitionBy("part", "rank").orderBy("step")
    place = F.array_position(F.array(*[F.lit(f) for f in names]), F.col("filter")).cast("int")
    removed = grid.join(changes, ["part", "step", "rank"], "left").withColumns({
        c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(running) for c in COUNTS})
    return removed.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"),
        (F.element_at("fails", place) - F.col("n")).alias("redundant"), F.element_at("alone", place).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"))


def filter_audit(
    docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column], copies: str = "E", doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """``audit`` of text conditions and of copies, over all rows of ``docs``.

    ``labels`` (doc_id, quality, toxic) says which ids are good or toxic; an id with several rows is what any of them says. Ids without
    a label, and null ids, are neither.
    """
    masks = failure_masks(docs, conditions, copies, doc_id, text, part)
    named = (
        labels.select(F.col("doc_id").alias("_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
        .where("good OR toxic").groupBy("_id").agg(*[F.max(c).alias(c) for c in ("good", "toxic")])
    )
    told = masks.join(stored(named, "labels"), F.col("doc_id") == F.col("_id"), "left")
    counts = told.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in ("good", "toxic")])
    return audit(counts, [*conditions, copies])
