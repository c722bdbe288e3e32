"""Scaling, scoring and ranking of features held as one array of doubles per document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from penprint.functions.arrays import name_category, row_mean
from penprint.functions.order import grouped_quantiles
from penprint.functions.quantiles import array_quantiles, feature_matrix

PERCENTILE = 75


# --- Scaling -------------------------------------------------------------------
@dataclass(frozen=True)
class Scaler:
    """(value - shift) / unit for each feature."""

    shift: list[float]
    unit: list[float]

    def apply(self, features: Column) -> Column:
        shift, unit = (F.array(*[F.lit(float(v)) for v in values]) for values in (self.shift, self.unit))
        return F.transform(features, lambda v, i: (v - F.get(shift, i)) / F.get(unit, i))

    def transform(self, df: DataFrame, features: str = "features", name: str | None = None) -> DataFrame:
        return df.withColumn(name or features, self.apply(F.col(features)))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(s), float(u)) for i, (s, u) in enumerate(zip(self.shift, self.unit))]
        spark.createDataFrame(rows, "index int, shift double, unit double").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Scaler:
        rows = spark.read.parquet(path).orderBy("index").collect()
        return Scaler([r["shift"] for r in rows], [r["unit"] for r in rows])


def feature_range(df: DataFrame, features: str = "features") -> tuple[list[float], list[float]]:
    vector = array_to_vector(F.col(features))
    row = df.agg(Summarizer.min(vector).alias("low"), Summarizer.max(vector).alias("high")).first()
    return row["low"].toArray().tolist(), row["high"].toArray().tolist()


def fit_minmax(train: DataFrame, features: str = "features") -> Scaler:
    """Scale to [0, 1] on the training rows; a constant feature is only shifted."""
    low, high = feature_range(train, features)
    return Scaler(low, [h - l if h > l else 1.0 for l, h in zip(low, high)])


def fit_robust(train: DataFrame, features: str = "features", exact: bool = True) -> Scaler:
    """Centre on the median and divide by the interquartile range, or by 1 where that is 0."""
    if exact:
        found = array_quantiles(train, F.col(features), [0.25, 0.5, 0.75])
    else:
        long = train.select(F.posexplode(features).alias("index", "value"))
        rows = grouped_quantiles(long, ["index"], "value", [0.25, 0.5, 0.75], exact).orderBy("index", "probability").collect()
        found = np.array([r["quantile"] for r in rows]).reshape(-1, 3)
    low, middle, high = found.T.tolist()
    return Scaler(middle, [b - a if b != a else 1.0 for a, b in zip(low, high)])


def varying_features(train: DataFrame, features: str = "features") -> list[int]:
    """Places of the features that are not constant."""
    low, high = feature_range(train, features)
    return [i for i, (l, h) in enumerate(zip(low, high)) if h > l]


def slice_features(features: Column, places: Sequence[int]) -> Column:
    return F.transform(F.array(*[F.lit(i) for i in places]), lambda i: F.get(features, i))


# --- Scores: one row per feature, columns ``index`` and ``score`` ------------------
def anova_scores(df: DataFrame, label: str, features: str = "features") -> DataFrame:
    """Ratio of the variance between labels to the variance inside them.

    Each label is summarised as one vector of means and variances; features are
    taken apart only after that, when one row per label is left.
    """
    vector = array_to_vector(F.col(features))
    per_label = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count("*").cast("double").alias("n"), Summarizer.mean(vector).alias("mean"), Summarizer.variance(vector).alias("variance")
    )
    cells = per_label.select(
        "n", F.posexplode(F.arrays_zip(vector_to_array("mean").alias("mean"), vector_to_array("variance").alias("variance"))).alias("index", "_c")
    ).select("index", "n", "_c.mean", "_c.variance")
    sums = cells.groupBy("index").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum((F.col("n") - 1) * F.col("variance")).alias("within"), F.collect_list(F.struct("n", "mean")).alias("_groups"),
    )
    between = F.aggregate("_groups", F.lit(0.0), lambda a, g: a + g["n"] * F.pow(g["mean"] - F.col("grand"), 2))
    score = (between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return sums.select("index", F.when((F.col("k") > 1) & (F.col("within") > 0), score).alias("score"))


def mutual_information(df: DataFrame, label: str, features: str = "features", bins: int = 10, label_bins: int | None = None) -> DataFrame:
    """Mutual information of each feature, cut into quantile bins, with the label.

    A continuous label is cut as well when ``label_bins`` is given. Edges are exact quantiles, the same in every run and
    whatever the partitioning. Counts of (feature, bin, label) are added up in the tasks, so no feature of a row is shuffled; the bin edges, ``bins - 1``
    numbers per feature, go to the tasks. A missing feature is in the lowest bin.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_label"), F.col(features).cast("array<double>").alias("_f"))
    if label_bins:
        cuts = array_quantiles(rows, F.array(F.col("_label").cast("double")), _inner(label_bins)).reshape(-1)
        rows = rows.withColumn("_label", sum(((F.col("_label") > float(cut)).cast("int") for cut in cuts), F.lit(0)))
    edges = array_quantiles(rows, F.col("_f"), _inner(bins))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            for start, values, known in feature_matrix(batch, 1):
                width = min(values.shape[1], len(edges))
                # As many edges as lie below a value; none below a missing one.
                bin_ = sum(((edges[:width, k] < values[:, :width]) & known[:, :width] for k in range(bins - 1)), np.zeros((len(values), width), np.int64))
                cell = (np.arange(width) * len(names) + code[start:start + len(values), None]) * bins + bin_
                for cell_, n in zip(*(x.tolist() for x in np.unique(cell, return_counts=True))):
                    place, bin_of = divmod(cell_, bins)
                    held[place // len(names), names[place % len(names)], bin_of] += n
        index, label_, bin_ = zip(*held) if held else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(index, pa.int32()), pa.array(label_, kind), pa.array(bin_, pa.int32()), pa.array(list(held.values()), pa.int64())], names=["index", "_label", "_bin", "n"])

    kind = to_arrow_type(rows.schema["_label"].dataType)
    counts = (
        rows.mapInArrow(count, StructType.fromDDL("index int").add(rows.schema["_label"]).add("_bin", "integer").add("n", "long"))
        .groupBy("index", "_label", "_bin").agg(F.sum("n").alias("count"))
    )
    total, row, column = (F.sum("count").over(Window.partitionBy("index", *more)) for more in ((), ("_bin",), ("_label",)))
    joint = F.col("count") / total
    return counts.withColumn("_part", joint * F.ln(F.col("count") * total / (row * column))).groupBy("index").agg(
        F.greatest(F.sum("_part"), F.lit(0.0)).alias("score")
    )


def _inner(bins: int) -> list[float]:
    return [i / bins for i in range(1, bins)]


def regression_scores(df: DataFrame, label: str, features: str = "features") -> DataFrame:
    """F statistic of each feature's correlation with a numeric label."""
    long = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), F.posexplode(F.col(features).cast("array<double>")).alias("index", "_x"))
    r2 = F.pow("_r", 2)
    return (
        long.groupBy("index").agg(F.corr("_x", "_y").alias("_r"), F.count("*").alias("_n"))
        .select("index", F.when(r2 < 1, r2 / (1 - r2) * (F.col("_n") - 2)).alias("score"))
    )


def top_percentile(scores: DataFrame, percentile: int = PERCENTILE) -> list[int]:
    """Places of the best features, ``int(percentile * n / 100)`` of them, ties to the lower place."""
    rows = scores.orderBy(F.desc_nulls_last("score"), "index").collect()
    return sorted(r["index"] for r in rows[: int(len(rows) * percentile / 100)])


# --- Selection --------------------------------------------------------------------
@dataclass(frozen=True)
class Selection:
    """Scalers and chosen places, all fitted on the training rows."""

    minmax: Scaler
    robust: Scaler
    chosen: dict[str, list[int]]

    def variants(self, df: DataFrame, features: str = "features") -> dict[str, DataFrame]:
        """The selected raw, min-max and robust tables of each method, and the two unselected scaled ones."""
        scaled = {"": F.col(features), "minmax": self.minmax.apply(F.col(features)), "robust": self.robust.apply(F.col(features))}
        out = {
            "_".join(part for part in (scale, method) if part): df.withColumn(features, slice_features(column, places))
            for method, places in self.chosen.items() for scale, column in scaled.items()
        }
        return out | {scale: df.withColumn(features, scaled[scale]) for scale in ("minmax", "robust")}

    def save(self, spark: SparkSession, path: str) -> None:
        self.minmax.save(spark, f"{path}/minmax")
        self.robust.save(spark, f"{path}/robust")
        rows = [(method, places) for method, places in self.chosen.items()]
        spark.createDataFrame(rows, "method string, places array<int>").write.mode("overwrite").parquet(f"{path}/chosen")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Selection:
        chosen = {r["method"]: list(r["places"]) for r in spark.read.parquet(f"{path}/chosen").collect()}
        return Selection(Scaler.load(spark, f"{path}/minmax"), Scaler.load(spark, f"{path}/robust"), chosen)


def fit_selection(
    train: DataFrame, label: str, features: str = "features", task_type: str = "classification", percentile: int = PERCENTILE, exact: bool = True
) -> Selection:
    """Fit both scalers and keep the best share of the varying features by each score."""
    varying = varying_features(train, features)
    kept = train.select(label, slice_features(F.col(features), varying).alias(features))
    if task_type == "classification":
        scores = {"ig": mutual_information(kept, label, features), "anova": anova_scores(kept, label, features)}
    else:
        scores = {"regression": regression_scores(kept, label, features)}
    chosen = {method: [varying[i] for i in top_percentile(s, percentile)] for method, s in scores.items()}
    return Selection(fit_minmax(train, features), fit_robust(train, features, exact), chosen)


def apply_to_other_corpus(selection: Selection, variant: str, df: DataFrame, features: str = "features") -> DataFrame:
    """Scale and cut a second corpus with what was fitted on the first."""
    return selection.variants(df, features)[variant]


# --- Ranking report ---------------------------------------------------------------
def named_scores(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """``feature``, ``category`` and ``score`` of the features with a score above 0."""
    known = F.array(*[F.lit(n) for n in names])
    named = scores.where(F.col("score") > 0).select(F.get(known, F.col("index")).alias("feature"), "score")
    return named.withColumn("category", name_category(F.col("feature")))


def top_features(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("score"), "feature").limit(k)


def worst_features(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.orderBy("score", "feature").limit(k)


def sorted_scores(scores: DataFrame, by: str = "score") -> DataFrame:
    return scores.orderBy("feature") if by == "name" else scores.orderBy(F.desc("score"), "feature")


def top_per_category(scores: DataFrame, n: int | None = 5) -> DataFrame:
    """Features ranked inside their category, the first ``n`` or all."""
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "feature"))
    ranked = scores.withColumn("place", place)
    return ranked if n is None else ranked.where(F.col("place") <= n)


def feature_means_by_label(df: DataFrame, label: str, names: Sequence[str], features: str = "features", labels: Sequence | None = None) -> DataFrame:
    """Mean of every feature per label: one row per feature, one column per label."""
    known = F.array(*[F.lit(n) for n in names])
    means = (
        df.where(F.col(label).isNotNull()).groupBy(label).agg(Summarizer.mean(array_to_vector(F.col(features))).alias("_m"))
        .select(F.col(label).alias("_label"), F.posexplode(vector_to_array("_m")).alias("_i", "_mean"))
        .select("_label", F.get(known, F.col("_i")).alias("feature"), "_mean")
    )
    return means.groupBy("feature").pivot("_label", list(labels) if labels is not None else None).agg(F.first("_mean"))


def category_profile(df: DataFrame, label: str, names: Sequence[str], features: str = "features") -> DataFrame:
    """Per label and category, the mean over documents of the row mean of the category's features.

    Nulls and NaN are skipped. Only one number per document and category is averaged.
    """
    categories = sorted({n.split("-")[0] for n in names if "-" in n})
    cells = F.array(*[
        F.struct(F.lit(c).alias("category"),
                 row_mean(slice_features(F.col(features), [i for i, n in enumerate(names) if n.startswith(c + "-")])).alias("value"))
        for c in categories
    ])
    long = df.where(F.col(label).isNotNull()).select(label, F.explode(cells).alias("_c")).select(label, "_c.*")
    return long.groupBy(label, "category").agg(F.avg("value").alias("value"))


def information_gain_report(df: DataFrame, label: str, names: Sequence[str], features: str = "features", task_type: str = "classification") -> dict[str, DataFrame]:
    """The ranking exports: by score, by name, best per category and, for labels, the means beside the scores."""
    regression = task_type == "regression"
    scores = named_scores(mutual_information(df, label, features, label_bins=10 if regression else None), names)
    top = 20 if regression else 10
    report = {
        "top": top_features(scores, top), "worst": worst_features(scores, 10),
        "by-coefficient": sorted_scores(scores), "by-name": sorted_scores(scores, "name"),
        "by-category-5": top_per_category(scores, 5), "by-category-all": top_per_category(scores, None),
    }
    if not regression:
        means = feature_means_by_label(df, label, names, features).join(scores.select("feature", "score"), "feature")
        report |= {"by-label": means.orderBy(F.desc("score"), "feature"), "by-label-and-name": means.orderBy("feature")}
    return report
