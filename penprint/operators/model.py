"""Training, search and prediction with Spark ML estimators."""

from __future__ import annotations

import random
import time
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from inspect import signature
from itertools import product

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.operators.evaluate import scheme_scores
from penprint.operators.forest import Draws, GrownForest, fit_forest, vote_tables
from penprint.operators.split import train_and_val
from penprint.session import checkpoint_folder
from penprint.spec import SPLIT

DEEPEST = 30
FEATURE_SETS = ("lf", "se", "we", "be", "ne", "bf", "cf", "fe", "pr", "ng", "cg")


def encode_label(df: DataFrame, label: str, name: str = "label_index") -> StringIndexerModel:
    """Code of each label: its rank in sorted order."""
    return StringIndexer(inputCol=label, outputCol=name, stringOrderType="alphabetAsc", handleInvalid="skip").fit(df)


def union_features(
    sets: Mapping[str, DataFrame], doc_id: str, rows: DataFrame | None = None, fill: float | None = None, features: str = "features", name: str = "features"
) -> DataFrame:
    """The chosen feature sets side by side, in the fixed order, for every document of ``rows``.

    Without ``rows``, for every document of any set. A document that a set does not know is an error that names it, unless
    ``fill`` gives the value of its missing features; null and NaN cells are filled alike. No document is dropped.
    """
    chosen = [s for s in FEATURE_SETS if s in sets] + [s for s in sets if s not in FEATURE_SETS]
    sides = {}
    for key in chosen:
        column = F.col(features)
        array = vector_to_array(column) if sets[key].schema[features].dataType.typeName() == "vectorudt" else column.cast("array<double>")
        sides[key] = sets[key].select(doc_id, array.alias(f"_{key}"))
    if rows is None:
        rows = reduce(DataFrame.union, [side.select(doc_id) for side in sides.values()]).distinct()
    out = rows.select(doc_id)
    for key, side in sides.items():
        width = side.agg(F.max(F.size(f"_{key}"))).first()[0] or 0
        column = F.col(f"_{key}")
        if fill is None:
            told = F.concat(F.lit(f"no features in set {key} for document "), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
            whole = F.when(column.isNotNull() & F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v)), column).otherwise(F.raise_error(told))
        else:
            whole = F.coalesce(F.transform(column, lambda v: F.coalesce(F.nanvl(v, F.lit(fill)), F.lit(fill))), F.array_repeat(F.lit(fill), width))
        out = out.join(side, doc_id, "left").withColumn(f"_{key}", whole)
    return out.select(doc_id, array_to_vector(F.concat(*[f"_{key}" for key in chosen])).alias(name))


def logistic_regression(
    features: str = "features", label: str = "label_index", fit_intercept: bool = True, max_iter: int = 4000, c: float = 1.0,
    rows: int | None = None, weight: str | None = None,
) -> LogisticRegression:
    """With the number of training rows, ``c`` sets the strength of the penalty as 1 / (c * rows)."""
    out = LogisticRegression(
        featuresCol=features, labelCol=label, maxIter=max_iter, fitIntercept=fit_intercept,
        regParam=1.0 / (c * rows) if rows else 0.0, standardization=False,
    )
    return out.setWeightCol(weight) if weight else out


def random_forest(
    features: str = "features", label: str = "label_index", trees: int = 200, depth: int | None = 10, min_leaf: int = 1, seed: int = 0,
    max_features: str = "sqrt",
) -> RandomForestClassifier:
    """No depth means as deep as Spark goes, 30; more is an error. ``max_features`` is a name (sqrt, log2, all) or a share.

    Spark has a least number of rows for a leaf, none for a node that is split. Rows keep the number of their node in every tree, so no task is sent
    the trees grown so far, nor follows them; the trees are the same.
    """
    if depth is not None and depth > DEEPEST:
        raise ValueError(f"trees are at most {DEEPEST} deep")
    return RandomForestClassifier(
        featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth or DEEPEST, minInstancesPerNode=min_leaf,
        featureSubsetStrategy=max_features, seed=seed, cacheNodeIds=True,
    )


def linear_regression(features: str = "features", label: str = "label_index", fit_intercept: bool = True, max_iter: int = 1000, penalty: float = 0.0) -> LinearRegression:
    return LinearRegression(featuresCol=features, labelCol=label, fitIntercept=fit_intercept, maxIter=max_iter, regParam=penalty)


def forest_regression(
    features: str = "features", label: str = "label_index", trees: int = 200, depth: int | None = 10, min_leaf: int = 1, seed: int = 0, max_features: str = "all",
) -> RandomForestRegressor:
    if depth is not None and depth > DEEPEST:
        raise ValueError(f"trees are at most {DEEPEST} deep")
    return RandomForestRegressor(
        featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth or DEEPEST, minInstancesPerNode=min_leaf, featureSubsetStrategy=max_features, seed=seed,
        cacheNodeIds=True)


def linear_svm(features: str = "features", label: str = "label_index", c: float = 1.0, max_iter: int = 100, rows: int | None = None) -> OneVsRest:
    """Linear kernel, one model per label; the penalty follows ``c`` as in logistic regression."""
    one = LinearSVC(
        featuresCol=features, labelCol=label, regParam=1.0 / (c * rows) if rows else 0.0, maxIter=max_iter, standardization=False)
    return OneVsRest(classifier=one, featuresCol=features, labelCol=label)


def layer_sizes(shape: str, layers: int, first: int) -> list[int]:
    """Neurons of each hidden layer.

    ``funnel`` divides by the layer's number and ``3angle`` is the same from
    back to front; ``brick`` is constant; ``lfunnel`` starts to halve after its
    middle; ``rhombus`` doubles up to the middle and halves after it; ``diamond``
    is flat at half size before the middle and halves after it.
    """
    middle = (layers + 1) // 2 - 1
    # With an even number of layers the last one repeats its neighbour.
    away = [min(i, 2 * middle) - middle for i in range(layers)]
    shapes = {
        "funnel": lambda: [round(first / (i + 1)) for i in range(layers)],
        "3angle": lambda: [round(first / (layers - i)) for i in range(layers)],
        "brick": lambda: [first] * layers,
        "lfunnel": lambda: [first if i < middle else round(first / 2 ** (i - middle + 1)) for i in range(layers)],
        "rhombus": lambda: [int(first / 2 ** abs(d)) for d in away],
        "diamond": lambda: [first // 2 if i < middle else int(first / 2 ** d) for i, d in enumerate(away)],
    }
    return shapes[shape]()


def dense_network(
    inputs: int, labels: int, shape: str = "brick", layers: int = 1, first: int = 16, features: str = "features", label: str = "label_index",
    max_iter: int = 100, seed: int = 0,
) -> MultilayerPerceptronClassifier:
    hidden = [max(1, n) for n in layer_sizes(shape, layers, first)]
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=[inputs, *hidden, labels], maxIter=max_iter, seed=seed)


# --- Search -------------------------------------------------------------------------
@dataclass(frozen=True)
class Search:
    """The refitted best model and the log of all trials; what was fitted for them, their settings and labels score them on other rows."""

    model: PipelineModel
    trials: DataFrame
    best: dict
    fitted: Sequence[tuple] = ()
    settings: Sequence[dict] = ()
    labels: Sequence[str] = ()


def sampled_trials(grid: Mapping[str, Mapping[str, Sequence]], draws: int, seed: int = 0) -> list[dict]:
    """Distinct random settings, each an estimator name and a value for each of its parameters; all settings if there are fewer."""
    every = [
        {"kind": kind} | dict(zip(grid[kind], values))
        for kind in sorted(grid) for values in product(*(dict.fromkeys(v) for v in grid[kind].values()))
    ]
    return random.Random(seed).sample(every, min(draws, len(every)))


BUILDERS = {"lr": logistic_regression, "rf": random_forest, "svm": linear_svm, "mlp": dense_network}
REGRESSION_BUILDERS = {"linear": linear_regression, "rf": forest_regression}


def random_search(
    df: DataFrame, label: str, grid: Mapping[str, Mapping[str, Sequence]], draws: int = 100, seed: int = 0, average: str = "macro",
    features: str = "features", split: str = SPLIT, refit_with_val: bool = False, builders: Mapping | None = None, task_type: str = "classification",
    at_once: int = 4,
) -> Search:
    """Fit each drawn setting on train, score it on val and refit the best.

    Forests that differ in the number of trees or the depth alone are fitted once, at the largest, and scored as parts of it (``forest``). Where train
    fits into one task, forests are grown there, one of them in each task.
    Up to ``at_once`` fits run at the same time, over a table in as many partitions as its size needs; one job then scores all trials.
    The cached table holds only label, split and features; rows without a label take no part. A label of val that train lacks counts as
    an error in every score. A regression is scored by its root mean squared error, and the smallest is the best. Each trial leaves one row in the log, best
    first, with the seconds of the fit it comes from and its share of the scoring. ``features`` may be an array or a vector.
    """
    vector = F.col(features)
    if df.schema[features].dataType.typeName() == "array":
        vector = array_to_vector(vector.cast("array<double>"))
    data = df.select(label, split, vector.alias("features")).where(F.col(label).isNotNull())
    regression = task_type == "regression"
    builders = builders or (REGRESSION_BUILDERS if regression else BUILDERS)
    if regression:
        coded = data.withColumn("label_index", F.col(label).cast("double")).persist()
        train, val = (coded.where(F.col(split) == name) for name in ("train", "val"))
        indexer, final = None, train_and_val(coded, split) if refit_with_val else train
    else:
        indexer = encode_label(data.where(F.col(split) == "train"), label)
        # A label that train does not have gets a code of its own: no model predicts it, so such rows count as errors.
        coded = indexer.copy().setHandleInvalid("keep").transform(data).persist()
        train, val = (coded.where(F.col(split) == name) for name in ("train", "val"))
        train = final = indexer.transform(train.drop("label_index"))
    first = train.select("features").first()
    size = {"rows": train.count(), "inputs": len(first["features"]) if first else 0, "labels": len(indexer.labels) if indexer else 1}
    trials = sampled_trials(grid, draws, seed)
    families = _families(trials, builders)
    draws = Draws(df.sparkSession)
    fitted = _fit_families(df.sparkSession, families, builders, size, in_partitions(train, size), at_once, draws)
    begin = time.monotonic()
    scores = _regression_scores(fitted, trials, val) if regression else _classification_scores(fitted, trials, val, average)
    share = (time.monotonic() - begin) / len(trials)
    seconds = {i: taken for _, taken, family in fitted for i in family.trials}
    log = [(-scores[i][0] if regression else scores[i][0], (t["kind"], {k: str(v) for k, v in t.items() if k != "kind"}, *scores[i], seconds[i], share), t)
           for i, t in enumerate(trials)]
    best = max(log, key=lambda row: row[0])[-1]
    labels = tuple(indexer.labels) if indexer else ()
    if refit_with_val and not regression:
        both = train_and_val(coded.drop("label_index"), split)
        indexer = encode_label(both, label)
        final = indexer.transform(both)
        size |= {"labels": len(indexer.labels)}
    estimator = _build(builders, best, size)
    final = in_partitions(final, size)
    stages = [estimator.setPredictionCol("predicted").fit(final)] if regression else [
        _fit(estimator, final, size, draws), IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)]
    coded.unpersist()
    ranked = sorted(log, key=lambda row: -row[0])
    table = df.sparkSession.createDataFrame(
        [(1 + sum(o[0] > row[0] for o in ranked), i == 0, *row[1]) for i, row in enumerate(ranked)],
        f"rank int, best boolean, kind string, params map<string,string>, score double, {'mse' if regression else 'accuracy'} double, fit_seconds double, score_seconds double",
    )
    return Search(PipelineModel(stages), table, best, tuple(fitted), tuple(trials), labels)


@dataclass(frozen=True)
class Family:
    """Trials by number that one fit, of ``setting``, serves."""

    setting: dict
    trials: list[int]
    nested: bool = False


def _families(trials: Sequence[dict], builders: Mapping) -> list[Family]:
    """Forests of this module that differ in trees and depth alone are one family, of the most trees and the greatest depth. The dearest come first."""
    out, forests = [], {}
    for i, trial in enumerate(trials):
        if builders[trial["kind"]] is random_forest:
            forests.setdefault(tuple(sorted((k, v) for k, v in trial.items() if k not in ("trees", "depth"))), []).append(i)
        else:
            out.append(Family(trial, [i]))
    usual = {k: signature(random_forest).parameters[k].default for k in ("trees", "depth")}
    for numbers in forests.values():
        own = [usual | trials[i] for i in numbers]
        depths = [t["depth"] for t in own]
        setting = own[0] | {"trees": max(t["trees"] for t in own), "depth": None if None in depths else max(depths)}
        out.insert(0, Family(setting, numbers, nested=True))
    return out


def in_partitions(rows: DataFrame, size: Mapping) -> DataFrame:
    """``rows`` in one partition for each 64 MB of features, if they lie in more."""
    return rows.coalesce(_partitions(size))


def _partitions(size: Mapping) -> int:
    return 1 + size["rows"] * (size["inputs"] + 2) * 8 // (64 << 20)


def _fit(estimator: Estimator, rows: DataFrame, size: Mapping, draws: Draws) -> Model:
    """``estimator`` fitted to ``rows``, which lie ``in_partitions``."""
    return fit_forest(estimator, rows, draws, _partitions(size) == 1) if type(estimator) is RandomForestClassifier else estimator.fit(rows)


def _fit_families(spark, families: Sequence[Family], builders: Mapping, size: Mapping, train: DataFrame, at_once: int, draws: Draws) -> list[tuple]:
    """(model, seconds) of every family; a bounded number of fits at the same time, each in a scheduler pool of its own.

    Node numbers of forests are checkpointed as the trees grow, or each job would carry the steps of all jobs before it.
    """
    checkpoint_folder(spark)
    train = train.persist()
    train.count()

    def fit(number: int) -> tuple[Model, float]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{number}")
        begin = time.monotonic()
        model = _fit(_build(builders, families[number].setting, size), train, size, draws)
        return model, time.monotonic() - begin

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        out = list(pool.map(inheritable_thread_target(spark)(fit), range(len(families))))
    train.unpersist()
    return [(model, taken, family) for (model, taken), family in zip(out, families)]


def trial_counts(fitted: Sequence[tuple], trials: Sequence[dict], rows: DataFrame, label: str = "label_index") -> DataFrame:
    """``trial``, actual ``label``, ``prediction`` and ``n``, the rows that have them, of all trials.

    Every model adds a column to the row; Spark's forests add the leaves it falls into, from which all their parts are told. Forests grown in one task look
    at the rows one forest after the other, so that a task holds the trees of one. Counts are added up in the task.
    """
    spark = rows.sparkSession
    plain = [(model, family.trials[0]) for model, _, family in fitted if not family.nested]
    forests = []
    seen = rows.select(F.col(label).alias("_label"), "features")
    for model, number in plain:
        seen = model.transform(seen).select(*seen.columns, F.col("prediction").alias(f"_p{number}"))
    counted = []
    for model, _, family in fitted:
        if not family.nested:
            continue
        settings = [(i, trials[i].get("trees", family.setting["trees"]), trials[i].get("depth", family.setting["depth"])) for i in family.trials]
        if isinstance(model, GrownForest):
            counted.append(model.counts(rows, settings, label))
            continue
        place = len(forests)
        votes = vote_tables(model, [depth for *_, depth in settings], spark)
        forests.append((settings, spark.sparkContext.broadcast(votes)))
        seen = model.copy({model.leafCol: "_leaf"}).transform(seen).select(*seen.columns, vector_to_array("_leaf").cast("array<int>").alias(f"_f{place}"))
    numbers = [number for _, number in plain]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                actual = part.column(0).to_numpy(zero_copy_only=False)
                for place, number in enumerate(numbers):
                    found.update((number, a, p) for a, p in zip(actual.tolist(), part.column(1 + place).to_pylist()))
                for place, (settings, votes) in enumerate(forests):
                    leaves = part.column(1 + len(numbers) + place).flatten().to_numpy(zero_copy_only=False).reshape(len(actual), -1)
                    for depth in dict.fromkeys(d for *_, d in settings):
                        own = [(i, trees) for i, trees, d in settings if d == depth]
                        said = votes.value.predictions(leaves, depth, [trees for _, trees in own])
                        for column, (number, _) in enumerate(own):
                            found.update((number, a, float(p)) for a, p in zip(actual.tolist(), said[:, column].tolist()))
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.float64()), pa.array([k[2] for k in keys], pa.float64()),
             pa.array(list(found.values()), pa.int64())], names=["trial", label, "prediction", "n"])

    if numbers or forests:
        counted.append(seen.drop("features").mapInArrow(count, f"trial int, `{label}` double, prediction double, n long"))
    return reduce(DataFrame.unionAll, counted).groupBy("trial", label, "prediction").agg(F.sum("n").alias("n"))


def _classification_scores(fitted: Sequence[tuple], trials: Sequence[dict], val: DataFrame, average: str) -> dict[int, tuple]:
    rows = scheme_scores(trial_counts(fitted, trials, val), "label_index", "prediction", ["trial"], "n").collect()
    return dict.fromkeys(range(len(trials)), (0.0, 0.0)) | {row["trial"]: (float(row[f"f1_{average}"]), float(row["accuracy"])) for row in rows}


def _regression_scores(fitted: Sequence[tuple], trials: Sequence[dict], val: DataFrame) -> dict[int, tuple]:
    """Root mean squared and mean squared error of every trial, in one pass."""
    seen = val.select(F.col("label_index").alias("_label"), "features")
    for model, _, family in fitted:
        seen = model.transform(seen).select(*seen.columns, F.col("prediction").alias(f"_p{family.trials[0]}"))
    row = seen.agg(*[F.avg((F.col(f"_p{i}") - F.col("_label")) ** 2).alias(str(i)) for i in range(len(trials))]).first()
    return {i: (float(row[str(i)]) ** 0.5, float(row[str(i)])) for i in range(len(trials))}


def _build(builders: Mapping, trial: Mapping, size: Mapping) -> Estimator:
    """An estimator for a trial; what it wants to know of the data is given by name."""
    build = builders[trial["kind"]]
    wanted = {name: value for name, value in size.items() if name in signature(build).parameters}
    return build(**(wanted | {k: v for k, v in trial.items() if k != "kind"}))


def run_summary(train: DataFrame, label: str, trials: DataFrame, metric: str = "score") -> DataFrame:
    """One row about a run: labels, rows, the smallest and largest class weight and the best metric."""
    from penprint.operators.stats import class_weights

    weights = class_weights(train, label).agg(
        F.count("*").alias("labels"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"))
    return weights.withColumn("rows", train.agg(F.count("*")).scalar()).withColumn("best_score", trials.agg(F.max(metric)).scalar())


# --- Prediction -----------------------------------------------------------------------
def predict_labels(df: DataFrame, probabilities: str, labels: Sequence[str], task_type: str = "classification", name: str = "predicted") -> DataFrame:
    """Label names from an array of probabilities, labels in sorted order.

    One probability is that of the second label and wins at 0.5. Several give
    the largest, the first on ties. Multi-label keeps every label of at least 0.5;
    a regression passes its value through.
    """
    p, names = F.col(probabilities), F.array(*[F.lit(v) for v in labels])
    if task_type == "regression":
        return df.withColumn(name, F.get(p, F.lit(0)))
    if task_type == "multi_label":
        chosen = F.filter(F.transform(names, lambda v, i: F.when(F.get(p, i) >= 0.5, v)), lambda v: v.isNotNull())
        return df.withColumn(name, F.array_join(chosen, "; "))
    single = F.when(F.get(p, F.lit(0)) >= 0.5, labels[-1]).otherwise(labels[0])
    several = F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    return df.withColumn(name, F.when(F.size(p) == 1, single).otherwise(several))


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
    """Predicted label, and the probabilities if the model gives them, next to the kept columns."""
    rows = df
    if df.schema[features].dataType.typeName() == "array":
        rows = df.withColumn(features, array_to_vector(F.col(features).cast("array<double>")))
    out = model.transform(rows.withColumnRenamed(features, "features") if features != "features" else rows)
    extra = [vector_to_array("probability").alias("probabilities")] if "probability" in out.columns else []
    return out.select(*keep, "predicted", *extra)


def save_stage(stage, path: str) -> None:
    """Store a fitted pipeline or stage."""
    stage.write().overwrite().save(path)


def load_stage(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_pipeline(*stages) -> Pipeline:
    return Pipeline(stages=list(stages))


def cross_corpus_scores(search: Search, selection, variant: str, other: DataFrame, label: str, features: str = "features") -> DataFrame:
    """Accuracy and F1 of a model trained on one corpus over another, scaled and cut as the first."""
    from penprint.operators.select import apply_to_other_corpus

    scored = predict(search.model, apply_to_other_corpus(selection, variant, other, features), [label], features)
    return scheme_scores(scored, label, "predicted")


def cross_corpus_trials(search: Search, selection, variant: str, other: DataFrame, label: str, features: str = "features") -> DataFrame:
    """Accuracy and F1 over another corpus of every trial of a search, as it was fitted on train: ``kind``, ``params`` and the scores.

    All trials are scored in one pass over the corpus, which is scaled and cut as the first. A label that train lacks counts as an error.
    """
    from penprint.operators.select import apply_to_other_corpus

    spark = other.sparkSession
    rows = apply_to_other_corpus(selection, variant, other, features).where(F.col(label).isNotNull())
    codes = StringIndexerModel.from_labels(list(search.labels), label, "label_index", handleInvalid="keep")
    coded = codes.transform(rows.select(label, array_to_vector(features).alias("features")))
    scores = scheme_scores(trial_counts(search.fitted, search.settings, coded), "label_index", "prediction", ["trial"], "n")
    named = [(i, t["kind"], {k: str(v) for k, v in t.items() if k != "kind"}) for i, t in enumerate(search.settings)]
    return scores.join(F.broadcast(spark.createDataFrame(named, "trial int, kind string, params map<string,string>")), "trial").drop("trial")
