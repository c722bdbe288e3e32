"""Combining the predictions of several feature sets.

Input is long: one row per (document, model) for votes and one per (document,
model, label) for probabilities, so no column names are parsed and every
combination is a plain aggregate per document. Ties go to the smallest label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.operators.evaluate import scheme_scores
from penprint.operators.merge import vote_by_author

DEALT = 2_000_000  # rows of a partition, some 250 MB of aggregates


def parts_of(df: DataFrame) -> int:
    """How many partitions to deal ``df`` into, so that each holds about ``DEALT`` rows at most, however well they compress."""
    return max(1 + df.count() // DEALT, df.sparkSession.sparkContext.defaultParallelism)


def ensemble_mode(votes: DataFrame, doc_id: str, predicted: str = "predicted") -> DataFrame:
    """Most frequent prediction of each document."""
    return vote_by_author(votes, doc_id, predicted)


def ensemble_weights(validation: DataFrame, model: str, actual: str, predicted: str = "predicted") -> DataFrame:
    """Each model's share of the summed weighted F1 on validation: columns model, ``weight``."""
    scores = scheme_scores(validation, actual, predicted, [model]).select(model, "f1_weighted")
    total = scores.agg(F.sum("f1_weighted")).scalar()
    return scores.select(model, (F.col("f1_weighted") / total).alias("weight"))


def ensemble_weighted(votes: DataFrame, weights: DataFrame, doc_id: str, model: str, predicted: str = "predicted") -> DataFrame:
    """Prediction with the largest total weight. Sums are compared to 12 decimals, so that
    the order of addition cannot decide a tie. Votes are dealt by document once, for both sums and choice."""
    totals = (
        votes.join(weights, model).select(doc_id, predicted, "weight").repartition(parts_of(votes), doc_id).groupBy(doc_id, predicted)
        .agg(F.round(F.sum("weight"), 12).alias("weight"))
    )
    return totals.groupBy(doc_id).agg(F.min_by(predicted, F.struct(-F.col("weight"), F.col(predicted))).alias(predicted))


def ensemble_mean(probabilities: DataFrame, doc_id: str, label: str = "label", p: str = "p") -> DataFrame:
    """Label with the largest mean probability over the models."""
    means = probabilities.select(doc_id, label, p).repartition(parts_of(probabilities), doc_id).groupBy(doc_id, label).agg(F.round(F.avg(p), 12).alias("_p"))
    return means.groupBy(doc_id).agg(F.min_by(label, F.struct(-F.col("_p"), F.col(label))).alias("predicted"))


def ensemble_highest(probabilities: DataFrame, doc_id: str, label: str = "label", p: str = "p") -> DataFrame:
    """Label with the single largest probability over all models."""
    return probabilities.groupBy(doc_id).agg(F.min_by(label, F.struct(-F.col(p), F.col(label))).alias("predicted"))


def vote_probabilities(
    winners: DataFrame, votes: DataFrame, probabilities: DataFrame, doc_id: str, model: str, label: str = "label", p: str = "p",
    predicted: str = "predicted",
) -> DataFrame:
    """Mean probability of every label over the models that voted for the winner.

    Every table is dealt by document once. The models that agree with the winner are an array for each document, which its probabilities look into;
    means are an aggregate of documents and labels where the rows already are.
    """
    parts = parts_of(probabilities)
    held = (
        votes.select(doc_id, F.struct(F.col(model).alias("model"), F.col(predicted).alias("predicted")).alias("_vote")).repartition(parts, doc_id)
        .groupBy(doc_id).agg(F.collect_list("_vote").alias("_votes"))
    )
    chosen = winners.groupBy(doc_id).agg(F.max(predicted).alias("_winner"))
    agreeing = held.join(chosen, doc_id).select(
        doc_id, F.transform(F.filter("_votes", lambda v: v["predicted"] == F.col("_winner")), lambda v: v["model"]).alias("_agreeing"))
    cells = probabilities.select(doc_id, model, F.col(label).alias(label), F.col(p).cast("double").alias(p)).where(F.col(p).isNotNull()).repartition(parts, doc_id)
    return (
        cells.join(agreeing, doc_id).where(F.array_contains("_agreeing", F.col(model)))
        .groupBy(doc_id, label).agg(F.avg(p).alias(p))
    )


def ensemble_regression(predictions: DataFrame, doc_id: str, predicted: str = "predicted") -> DataFrame:
    """Mean of the predictions of each document."""
    return predictions.groupBy(doc_id).agg(F.avg(predicted).alias(predicted))
