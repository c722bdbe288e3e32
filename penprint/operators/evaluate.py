"""Reports on predictions, per document and per author.

Each report starts from counts of (actual, predicted) pairs, so documents are
read once and everything after works on one row per pair of labels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.functions import lexicon as lx
from penprint.functions.arrays import f1
from penprint.operators.merge import vote_by_author


def label_scores(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Hits, support, predictions, precision, recall and F1 per label (shares, not percent). A row counts ``weight`` times."""
    pairs = df.groupBy(*by, F.col(actual).alias("_a"), F.col(predicted).alias("_p")).agg((F.sum(weight) if weight else F.count("*")).alias("count"))
    n, hit = F.col("count"), F.col("_a") == F.col("_p")
    sides = F.array(
        F.struct(F.col("_a").alias("label"), F.when(hit, n).otherwise(0).alias("tp"), n.alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("_p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), n.alias("predicted")),
    )
    totals = (
        pairs.select(*by, F.explode(sides).alias("_s")).select(*by, "_s.*").where(F.col("label").isNotNull())
        .groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )
    precision = _ratio(F.col("tp"), F.col("predicted"))
    recall = _ratio(F.col("tp"), F.col("support"))
    return totals.withColumns({"precision": precision, "recall": recall}).withColumn("f1_score", f1(F.col("precision"), F.col("recall")))


def classification_report(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Per label, then accuracy, macro and weighted averages, in percent.

    A zero denominator counts as 0. ``by`` makes one report per group, as per trial.
    """
    scores = label_scores(df, actual, predicted, by)
    measures = ("precision", "recall", "f1_score")
    averages = scores.groupBy(*by).agg(
        F.sum("support").alias("support"), _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures],
    )

    def line(label: str, columns: Sequence[str]) -> Column:
        return F.struct(F.lit(label).alias("label"), *[F.col(c).alias(m) for c, m in zip(columns, measures)], F.col("support"))

    lines = F.array(
        line("accuracy", ["accuracy"] * 3),
        line("macro avg", [f"macro_{m}" for m in measures]),
        line("weighted avg", [f"weighted_{m}" for m in measures]),
    )
    summary = averages.select(*by, F.explode(lines).alias("_l")).select(*by, "_l.*")
    labels = scores.select(*by, F.col("label").cast("string").alias("label"), *measures, "support")
    return labels.unionByName(summary).withColumns({m: F.col(m) * 100 for m in measures})


def scheme_scores(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Accuracy and the micro, macro and weighted F1, one row per group."""
    return label_scores(df, actual, predicted, by, weight).groupBy(*by).agg(
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        _ratio(2 * F.sum("tp"), F.sum("predicted") + F.sum("support")).alias("f1_micro"),
        F.avg("f1_score").alias("f1_macro"),
        _ratio(F.sum(F.col("f1_score") * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence, normalize: bool = True) -> DataFrame:
    """Rows are actual labels, one column per predicted label, as counts or shares of the row."""
    kind = df.schema[actual].dataType.simpleString()
    rows = df.sparkSession.createDataFrame([(v,) for v in labels], f"actual {kind}")
    counts = (
        df.where(F.col(actual).isin(list(labels)) & F.col(predicted).isin(list(labels)))
        .groupBy(F.col(actual).alias("actual")).pivot(predicted, list(labels)).count()
    )
    full = rows.join(counts, "actual", "left").na.fill(0)
    if not normalize:
        return full
    total = sum((F.col(f"`{v}`") for v in labels), F.lit(0))
    return full.select("actual", *[_ratio(F.col(f"`{v}`"), total).alias(str(v)) for v in labels])


def multilabel_confusion(df: DataFrame, actual: str, predicted: str, separator: str = lx.MULTI_LABEL_SEPARATOR) -> DataFrame:
    """True and false positives and negatives per label of separated lists."""
    a, p = (F.split(F.coalesce(F.col(c), F.lit("")), separator) for c in (actual, predicted))
    cells = F.transform(
        F.array_union(a, p),
        lambda v: F.struct(v.alias("label"), F.array_contains(a, v).alias("a"), F.array_contains(p, v).alias("p")),
    )
    n = df.agg(F.count("*")).scalar()
    return (
        df.select(F.explode(cells).alias("_c")).select("_c.*").where(F.col("label") != "")
        .groupBy("label").agg(
            F.count_if(F.col("a") & F.col("p")).alias("tp"),
            F.count_if(~F.col("a") & F.col("p")).alias("fp"),
            F.count_if(F.col("a") & ~F.col("p")).alias("fn"),
        )
        .withColumn("tn", n - F.col("tp") - F.col("fp") - F.col("fn"))
    )


def micro_scores(df: DataFrame, actual: str, predicted: str, labels: Sequence | None = None) -> DataFrame:
    """Precision, recall and F1 over all labels at once, or over the listed ones."""
    scores = label_scores(df, actual, predicted)
    if labels is not None:
        scores = scores.where(F.col("label").isin(list(labels)))
    sums = scores.agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"))
    return sums.select(
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall")
    ).withColumn("f1_score", f1(F.col("precision"), F.col("recall")))


def regression_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    error = F.avg(F.pow(F.col(predicted) - F.col(actual), 2))
    return df.agg(error.alias("mse"), F.sqrt(error).alias("rmse"))


def author_predictions(df: DataFrame, author: str, actual: str, predicted: str) -> DataFrame:
    """Voted actual and predicted label per author, joined by author."""
    return vote_by_author(df, author, actual).join(vote_by_author(df, author, predicted), author)


def author_report(df: DataFrame, author: str, actual: str, predicted: str) -> DataFrame:
    return classification_report(author_predictions(df, author, actual, predicted), actual, predicted)


def sweep(predictions: DataFrame, trials: DataFrame, trial: str, actual: str, predicted: str, suffix: str = "") -> DataFrame:
    """The trial log with the macro and weighted F1 of every trial, all trials in one aggregation."""
    scores = scheme_scores(predictions, actual, predicted, [trial])
    return trials.join(
        scores.select(trial, F.col("f1_macro").alias(f"f1_macro{suffix}"), F.col("f1_weighted").alias(f"f1_weighted{suffix}")),
        trial, "left",
    )


# --- Trial logs and result tables ------------------------------------------------
def best_trial(trials: DataFrame, metric: str, criteria: Mapping[str, object] | None = None, larger: bool = True) -> DataFrame:
    """The trial that matches the criteria and has the best metric, as one row."""
    for name, value in (criteria or {}).items():
        trials = trials.where(F.col(name) == F.lit(value))
    order = F.col(metric).desc_nulls_last() if larger else F.col(metric).asc_nulls_last()
    return trials.orderBy(order, *[c for c in trials.columns if c != metric]).limit(1)


def flagged_trial(trials: DataFrame, group: str, flag: str, position: str) -> DataFrame:
    """The last trial flagged best in each group."""
    flagged = trials.where(F.col(flag) == 1)
    last = F.max_by(F.struct(*[c for c in trials.columns if c != group]), position)
    return flagged.groupBy(group).agg(last.alias("_t")).select(group, "_t.*")


def leaderboard(reports: DataFrame, feature_set: str = "feature_set", label: str = "label", score: str = "f1_score") -> DataFrame:
    """Feature set by label F1 in percent with the best of each label marked.

    The result is long: one row per feature set and label, which ``wide_leaderboard`` pivots.
    """
    best = F.rank().over(Window.partitionBy(label).orderBy(F.desc(score))) == 1
    return reports.groupBy(feature_set, label).agg(F.round(F.max(score), 4).alias(score)).withColumn("best", best)


def wide_leaderboard(reports: DataFrame, labels: Sequence[str], feature_set: str = "feature_set", label: str = "label", score: str = "f1_score") -> DataFrame:
    return reports.groupBy(feature_set).pivot(label, list(labels)).agg(F.round(F.max(score), 4))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
