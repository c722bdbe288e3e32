"""Counts, distributions and profiles of a corpus.

Everything counts on the map side before it shuffles, so a label, author or
value that holds a third of the rows costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.functions import lexicon as lx
from penprint.functions.arrays import month_period, split_labels
from penprint.functions.order import grouped_quantiles
from penprint.functions.quantiles import array_quantiles
from penprint.functions.text import clean
from penprint.session import stored
from penprint.spec import SPLIT, SPLITS


def docs_per_author(df: DataFrame, author: str) -> DataFrame:
    return df.groupBy(author).count()


def docs_per_author_month(df: DataFrame, author: str, ts: str) -> DataFrame:
    return df.groupBy(author, month_period(F.col(ts)).alias("month")).count()


def docs_per_author_language(df: DataFrame, author: str, language: str) -> DataFrame:
    return df.where(F.col(language).isNotNull()).groupBy(author, language).count()


def label_distribution(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and share of each non-null label, overall or inside each group of ``by``."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).count()
    # The window runs over one row per label, not over documents.
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each split name or author."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count()
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share", F.col("count") / total)


def multi_label_distribution(df: DataFrame, label: str, separator: str = lx.MULTI_LABEL_SEPARATOR) -> DataFrame:
    parts = df.where(F.col(label).isNotNull()).select(F.explode(F.split(F.col(label), separator)).alias("label"))
    return parts.groupBy("label").count()


def date_bounds(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))


def docs_per_month(df: DataFrame, ts: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).groupBy(month_period(F.col(ts)).alias("month")).count()


def describe_numeric(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row per column."""
    numbers = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    summaries = [measure(f"_{i}").alias(f"{name}_{i}") for i in range(len(columns)) for name, measure in measures.items()]
    probabilities = (0.25, 0.5, 0.75)
    if exact:
        found = array_quantiles(numbers, F.array(*numbers.columns), probabilities)
        found = np.vstack([found, np.full((len(columns) - len(found), 3), np.nan)]).tolist()
        quartiles = [[F.lit(v) for v in row] for row in found]
    else:
        summaries += [F.percentile_approx(f"_{i}", list(probabilities), 10000).alias(f"_q{i}") for i in range(len(columns))]
        quartiles = [[F.get(f"_q{i}", F.lit(k)) for k in range(3)] for i in range(len(columns))]
    lines = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name in measures], *[q.alias(name) for q, name in zip(quartiles[i], ("q25", "q50", "q75"))])
        for i, c in enumerate(columns)]
    return numbers.agg(*summaries).select(F.explode(F.array(*lines)).alias("_l")).select("_l.*").where("count > 0")


def length_profile(df: DataFrame, text: str, language: str = "es", exact: bool = True, pipeline=None) -> DataFrame:
    """``describe_numeric`` of the length in characters of the cleaned text.

    The quantiles read the lengths several times: stored, so that no text is cleaned twice.
    """
    lengths = clean(df, text, pipeline=pipeline, language=language).select(F.char_length(text).alias("length"))
    return describe_numeric(stored(lengths), ["length"], exact)


def categorical_profile(df: DataFrame, columns: Sequence[str], split: str = SPLIT) -> DataFrame:
    """Count of each value of each column, over all rows and inside each split."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = (
        df.select(F.col(split).alias("split"), F.explode(cells).alias("_c"))
        .select("split", "_c.column", "_c.value").where(F.col("value").isNotNull())
        .groupBy("column", "split", "value").count()
    )
    scopes = F.when(F.col("split").isin(*SPLITS), F.array(F.lit("all"), "split")).otherwise(F.array(F.lit("all")))
    return (
        counts.withColumn("split", F.explode(scopes))
        .groupBy("column", "split", "value").agg(F.sum("count").alias("count"))
    )


def available_labels(df: DataFrame, label: str, split: str = SPLIT, task_type: str = "classification") -> DataFrame:
    """Distinct labels of the training rows, or of all rows if training has none.

    Multi-label cells are split at ``;``; a regression has no labels.
    """
    rows = df.where(F.col(label).isNotNull())
    if task_type == "regression":
        return rows.select(label).limit(0)
    if task_type == "multi_label":
        parts = rows.where(F.col(split) == "train").select(label).distinct()
        return parts.select(F.explode(split_labels(F.col(label))).alias(label)).distinct().orderBy(label)
    seen = rows.groupBy(label).agg(F.max(F.coalesce(F.col(split) == "train", F.lit(False))).alias("_train"))
    any_train = seen.agg(F.max("_train")).scalar()
    return seen.where(F.col("_train") | ~any_train).select(label).orderBy(label)


def num_labels(df: DataFrame, label: str, split: str = SPLIT, task_type: str = "classification") -> DataFrame:
    """How many labels training has, as one row; 1 for a regression."""
    if task_type == "regression":
        return df.sparkSession.createDataFrame([(1,)], "labels long")
    rows = df.where((F.col(split) == "train") & F.col(label).isNotNull()).select(F.col(label).alias("_label"))
    if task_type == "multi_label":
        rows = rows.select(F.explode(split_labels(F.col("_label"))).alias("_label"))
    return rows.distinct().agg(F.count("*").alias("labels"))


def is_imbalanced(
    df: DataFrame, label: str, threshold: float = lx.IMBALANCE_THRESHOLD, balanced: bool | None = None, task_type: str = "classification"
) -> DataFrame:
    """Whether the sample deviation of the label shares exceeds the threshold, as one row.

    A ``balanced`` setting decides by itself; a regression is never imbalanced.
    """
    deviation = label_distribution(df, label).agg(F.stddev_samp("share").alias("deviation"))
    if task_type == "regression" or balanced is not None:
        return deviation.withColumn("imbalanced", F.lit(task_type != "regression" and not balanced))
    return deviation.withColumn("imbalanced", F.coalesce(F.col("deviation") > threshold, F.lit(False)))


def author_mad(df: DataFrame, author: str, scale: float = lx.MAD_SCALE, exact: bool = True) -> DataFrame:
    """Median absolute deviation of the documents per author, over ``scale``, rounded."""
    counts = docs_per_author(df, author).select(F.col("count").cast("double").alias("n"))
    median = grouped_quantiles(counts, [], "n", [0.5], exact).select("quantile").scalar()
    spread = counts.select(F.abs(F.col("n") - median).alias("n"))
    return grouped_quantiles(spread, [], "n", [0.5], exact).select(F.bround(F.col("quantile") / scale).cast("long").alias("mad"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight of each label: n / (labels * count)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count()
    totals = counts.agg((F.sum("count") / F.count("*"))).scalar()
    return counts.select(label, (totals / F.col("count")).alias("weight"))


def sample_weights(df: DataFrame, label: str, labels: Sequence[str], separator: str = lx.MULTI_LABEL_SEPARATOR, name: str = "weight") -> DataFrame:
    """Balanced weight of each multi-label row: the product of the balanced weights of its indicators."""
    parts = F.split(F.col(label), separator)
    held = {v: F.coalesce(F.array_contains(parts, v), F.lit(False)) for v in labels}
    row = df.agg(F.count("*"), *[F.count_if(h) for h in held.values()]).first()
    n, weight = row[0], F.lit(1.0)
    for has, positives in zip(held.values(), row[1:]):
        kinds = 2 if 0 < positives < n else 1
        weight = weight * F.when(has, n / (kinds * max(positives, 1))).otherwise(n / (kinds * max(n - positives, 1)))
    return df.withColumn(name, weight)


def initial_log_odds(df: DataFrame, label: str) -> DataFrame:
    """ln(smaller count / larger count) of a two-label column, as one row."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count()
    return counts.agg(F.ln(F.min("count") / F.max("count")).alias("log_odds"))


def smallest_group(df: DataFrame, author: str) -> DataFrame:
    return docs_per_author(df, author).agg(F.min("count").alias("documents"))


def distinct_values(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns).distinct()
