"""Queries for scaling, feature scores, rankings and models, over the embedding table.

Its 64 numbers stand for features ``a-00 … d-15`` in four categories. Labels 0 to 5
are the training rows, 6 and 7 validation, the rest test, where a split is needed.
"""

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.catalog.base import query, r6, table
from penprint.operators import model, select, stats
from penprint.session import checkpoint_folder, spread

NAMES = [f"{c}-{i:02d}" for c in "abcd" for i in range(16)]
_X = """x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS index FROM embeddings)"""
_NAME = "['a', 'b', 'c', 'd'][index // 16 + 1] || '-' || lpad(CAST(index % 16 AS VARCHAR), 2, '0')"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


def training(df):
    return df.where(F.col("label") <= 5)


def _long(df, *keys):
    return df.select(*keys, F.posexplode("features").alias("index", "value")).select(
        *keys, F.col("index").cast("long").alias("index"), r6("value").alias("value"))


@query(f"""WITH {_X}, s AS (SELECT index, min(v) AS lo, max(v) AS hi FROM x WHERE label <= 5 GROUP BY 1)
           SELECT vec_id, index, round((v - lo) / (hi - lo), 6) AS value FROM x JOIN s USING (index)""")
def minmax_scaling(spark, sf):
    df = vectors(spark, sf)
    return _long(select.fit_minmax(training(df)).transform(df), "vec_id")


@query(f"""WITH {_X}, s AS (SELECT index, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM x WHERE label <= 5 GROUP BY 1)
           SELECT vec_id, index, round((v - m) / (b - a), 6) AS value FROM x JOIN s USING (index)""")
def robust_scaling(spark, sf):
    df = vectors(spark, sf)
    return _long(select.fit_robust(training(df)).transform(df), "vec_id")


@query("""WITH x AS (SELECT unnest([l_discount, 1.0::DOUBLE, l_tax]) AS v, unnest([0, 1, 2]) AS index FROM lineitem)
          SELECT CAST(index AS BIGINT) AS index FROM x GROUP BY 1 HAVING var_pop(v) > 0""")
def variance_selection(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.array("l_discount", F.lit(1.0), "l_tax").alias("features"))
    return spark.createDataFrame([(i,) for i in select.varying_features(rows)], "index long")


_ANOVA = """g AS (SELECT index, label, count(*) AS n, avg(v) AS m, sum(v) AS s, var_samp(v) * (count(*) - 1) AS w FROM x GROUP BY 1, 2),
    t AS (SELECT index, avg(v) AS grand, count(*) AS total FROM x GROUP BY 1),
    anova AS (SELECT index, (sum(n * (m - grand) ** 2) / (count(*) - 1)) / (sum(w) / (any_value(total) - count(*))) AS score FROM g JOIN t USING (index) GROUP BY 1)"""


@query(f"WITH {_X}, {_ANOVA} SELECT index, round(score, 6) AS score FROM anova")
def anova_scores(spark, sf):
    return select.anova_scores(vectors(spark, sf), "label").select(F.col("index").cast("long").alias("index"), r6("score").alias("score"))


@query(f"WITH {_X}, {_ANOVA} SELECT CAST(index AS BIGINT) AS index FROM anova ORDER BY score DESC, index LIMIT 48")
def anova_selection(spark, sf):
    places = select.top_percentile(select.anova_scores(vectors(spark, sf), "label"))
    return spark.createDataFrame([(i,) for i in places], "index long")


_MI = """e AS (SELECT index, quantile_disc(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM x GROUP BY 1),
    b AS (SELECT index, label, len(list_filter(edges, lambda q: q < v)) AS bin, count(*) AS c FROM x JOIN e USING (index) GROUP BY 1, 2, 3),
    j AS (SELECT index, c, sum(c) OVER (PARTITION BY index) AS n, sum(c) OVER (PARTITION BY index, bin) AS r, sum(c) OVER (PARTITION BY index, label) AS k FROM b),
    mi AS (SELECT index, sum(c / n * ln(c * n / (r * k))) AS score FROM j GROUP BY 1)"""


@query(f"WITH {_X}, {_MI} SELECT index, round(score, 6) AS score FROM mi")
def mutual_information(spark, sf):
    return select.mutual_information(vectors(spark, sf), "label").select(F.col("index").cast("long").alias("index"), r6("score").alias("score"))


@query(f"WITH {_X} SELECT index, round(corr(v, label) ** 2 / (1 - corr(v, label) ** 2) * (count(*) - 2), 6) AS score FROM x GROUP BY 1")
def regression_scores(spark, sf):
    return select.regression_scores(vectors(spark, sf), "label").select(F.col("index").cast("long").alias("index"), r6("score").alias("score"))


@query(f"""WITH {_X}, {_ANOVA}, {_MI},
           s AS (SELECT index, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM x GROUP BY 1),
           chosen AS (SELECT 'anova' AS method, index FROM (SELECT index FROM anova ORDER BY score DESC, index LIMIT 48)
                      UNION ALL SELECT 'ig', index FROM (SELECT index FROM mi ORDER BY score DESC, index LIMIT 48)
                      UNION ALL SELECT '', index FROM s),
           k AS (SELECT method, index, row_number() OVER (PARTITION BY method ORDER BY index) - 1 AS place FROM chosen),
           scaled AS (SELECT vec_id, index, unnest(['', 'minmax', 'robust']) AS scale, unnest([v, (v - lo) / (hi - lo), (v - m) / (b - a)]) AS value FROM x JOIN s USING (index))
           SELECT scale || CASE WHEN scale <> '' AND method <> '' THEN '_' ELSE '' END || method AS variant, vec_id, place AS index, round(value, 6) AS value
           FROM scaled JOIN k USING (index) WHERE scale <> '' OR method <> ''""")
def selected_variant(spark, sf):
    """All eight tables: raw, min-max and robust for either score, and the two scaled ones of all features."""
    df = vectors(spark, sf)
    variants = select.fit_selection(df, "label").variants(df)
    return reduce(DataFrame.unionAll, [_long(out, "vec_id").select(F.lit(name).alias("variant"), "vec_id", "index", "value") for name, out in variants.items()])


@query(f"""WITH {_X}, s AS (SELECT index, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM x WHERE label <= 5 GROUP BY 1)
           SELECT vec_id, index, round((v - m) / (b - a), 6) AS value FROM x JOIN s USING (index) WHERE label > 5""")
def apply_to_other_corpus(spark, sf):
    df = vectors(spark, sf)
    fitted = select.fit_selection(training(df), "label")
    return _long(select.apply_to_other_corpus(fitted, "robust", df.where(F.col("label") > 5)), "vec_id")


@query(f"""WITH {_X}, {_MI}, n AS (SELECT {_NAME} AS feature, score FROM mi)
           SELECT feature, split_part(feature, '-', 1) AS category, round(score, 6) AS score,
                  CAST(row_number() OVER (PARTITION BY split_part(feature, '-', 1) ORDER BY score DESC, feature) AS INTEGER) AS place FROM n WHERE score > 0
           QUALIFY place <= 5""")
def top_per_category(spark, sf):
    report = select.information_gain_report(vectors(spark, sf), "label", NAMES)
    return report["by-category-5"].select("feature", "category", r6("score").alias("score"), "place")


@query(f"""WITH {_X}, {_MI}, n AS (SELECT {_NAME} AS feature, score FROM mi)
           SELECT feature, split_part(feature, '-', 1) AS category, round(score, 6) AS score,
                  CAST(row_number() OVER (PARTITION BY split_part(feature, '-', 1) ORDER BY score DESC, feature) AS INTEGER) AS place FROM n WHERE score > 0""")
def by_category_all(spark, sf):
    report = select.information_gain_report(vectors(spark, sf), "label", NAMES)
    return report["by-category-all"].select("feature", "category", r6("score").alias("score"), "place")


@query(f"""WITH {_X}, {_MI} SELECT {_NAME} AS feature, round(score, 6) AS score,
           CAST(row_number() OVER (ORDER BY score DESC, {_NAME}) AS INTEGER) AS place FROM mi WHERE score > 0""")
def sorted_scores(spark, sf):
    """All features by score, with the place in which they come; there are as many rows as features."""
    ordered = select.information_gain_report(vectors(spark, sf), "label", NAMES)["by-coefficient"].collect()
    rows = [(row["feature"], row["score"], place) for place, row in enumerate(ordered, 1)]
    return spark.createDataFrame(rows, "feature string, score double, place int").select("feature", r6("score").alias("score"), "place")


@query(f"WITH {_X}, {_MI} SELECT {_NAME} AS feature, round(score, 6) AS score FROM mi WHERE score > 0 ORDER BY mi.score DESC, 1 LIMIT 10")
def top_features(spark, sf):
    report = select.information_gain_report(vectors(spark, sf), "label", NAMES)
    return report["top"].select("feature", r6("score").alias("score"))


@query(f"WITH {_X}, {_MI} SELECT {_NAME} AS feature, round(score, 6) AS score FROM mi WHERE score > 0 ORDER BY mi.score, 1 LIMIT 10")
def worst_features(spark, sf):
    report = select.information_gain_report(vectors(spark, sf), "label", NAMES)
    return report["worst"].select("feature", r6("score").alias("score"))


_LABELS = range(10)


@query(f"""WITH {_X} SELECT {_NAME} AS feature, {", ".join(f'round(avg(v) FILTER (WHERE label = {v}), 6) AS "{v}"' for v in _LABELS)} FROM x GROUP BY 1""")
def feature_means_by_label(spark, sf):
    out = select.feature_means_by_label(vectors(spark, sf), "label", NAMES, labels=list(_LABELS))
    return out.select("feature", *[r6(F.col(f"`{v}`")).alias(str(v)) for v in _LABELS])


@query(f"""WITH {_X}, {_MI} SELECT {_NAME} AS feature, {", ".join(f'round(avg(v) FILTER (WHERE label = {v}), 6) AS "{v}"' for v in _LABELS)},
           round(any_value(score), 6) AS score FROM x JOIN mi USING (index) WHERE score > 0 GROUP BY 1""")
def information_gain_report(spark, sf):
    report = select.information_gain_report(vectors(spark, sf), "label", NAMES)["by-label"]
    return report.select("feature", *[r6(F.col(f"`{v}`")).alias(str(v)) for v in _LABELS], r6("score").alias("score"))


@query(f"""WITH {_X}, r AS (SELECT vec_id, label, ['a', 'b', 'c', 'd'][index // 16 + 1] AS category, avg(v) AS m FROM x GROUP BY 1, 2, 3)
           SELECT label, category, round(avg(m), 6) AS value FROM r GROUP BY 1, 2""")
def category_profile(spark, sf):
    return select.category_profile(vectors(spark, sf), "label", NAMES).select("label", "category", r6("value").alias("value"))


# --- Models --------------------------------------------------------------------------
# The reference's settings, as far as Spark has them: depths beyond its 30 are the one of no depth, ``auto`` features are ``sqrt``, kernels linear.
GRID = {
    "lr": {"fit_intercept": [True, False]},
    "rf": {"trees": [200, 650, 1100, 1550, 2000], "depth": [10, None], "min_leaf": [1, 2, 4]},
    "svm": {"c": [1.0]},
}
# Those whose models give probabilities.
LIKELY = {kind: GRID[kind] for kind in ("lr", "rf")}


def _task(spark, sf):
    """Is the label below five, with a split by hash of the id."""
    from penprint.operators.split import random_split

    df = vectors(spark, sf).withColumn("group", F.when(F.col("label") < 5, "low").otherwise("high"))
    return random_split(df, "vec_id")


@query()
def random_search(spark, sf):
    search = model.random_search(_task(spark, sf), "group", GRID)
    return search.trials.select("rank", "best", "kind", r6("score").alias("score"), r6("accuracy").alias("accuracy"))


SAVED = {}  # where the searched model of an application's tables lies


def _likely_model(spark, sf):
    """The best model of one search for each application and folder of tables, saved in the shared folder and loaded from there."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in SAVED:
        path = f"{checkpoint_folder(spark)}/search-{uuid4().hex}"
        model.save_stage(model.random_search(_task(spark, sf), "group", LIKELY, refit_with_val=True).model, path)
        SAVED[key] = path
    return model.load_stage(SAVED[key])


@query()
def predict_labels(spark, sf):
    found = model.predict(_likely_model(spark, sf), _task(spark, sf), ["vec_id", "__split", "group"])
    return found.select("vec_id", "__split", "group", "predicted", r6(F.get("probabilities", F.lit(0))).alias("p"))


@query("SELECT CAST(range AS INTEGER) AS index, 0.0 AS gradient FROM range(65)")
def logistic_gradient(spark, sf):
    """Gradient of the penalised logistic loss at the fitted weights, to three decimals: the intercept last."""
    from pyspark.ml.functions import array_to_vector

    df = vectors(spark, sf).withColumn("y", (F.col("label") < 5).cast("double"))
    rows = df.count()
    fitted = model.logistic_regression(label="y", rows=rows).fit(df.withColumn("features", array_to_vector("features")))
    weights = F.array(*[F.lit(float(w)) for w in fitted.coefficients])
    margin = F.aggregate(F.zip_with("features", weights, lambda x, w: x * w), F.lit(float(fitted.intercept)), lambda a, v: a + v)
    error = (1 / (1 + F.exp(-margin)) - F.col("y")) / rows
    cells = df.select(error.alias("e"), F.posexplode(F.concat("features", F.array(F.lit(1.0)))).alias("index", "x"))
    penalty = F.coalesce(F.get(weights, F.col("index")), F.lit(0.0)) / rows
    summed = cells.groupBy("index").agg(F.sum(F.col("e") * F.col("x")).alias("g"))
    return summed.select("index", (F.round(F.col("g") + penalty, 3) + 0.0).alias("gradient"))


@query("""SELECT vec_id, 1 AS models, true AS likeliest FROM embeddings""")
def predictions_are_likeliest(spark, sf):
    """Whether the predicted label of each row is the one of the larger probability."""
    names = F.array(F.lit("high"), F.lit("low"))
    found = model.predict(_likely_model(spark, sf), _task(spark, sf), ["vec_id"])
    likeliest = F.get(names, (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int"))
    return found.groupBy("vec_id").agg(F.count("*").cast("int").alias("models"), F.bool_and(F.col("predicted") == likeliest).alias("likeliest"))


@query("SELECT CAST(i AS INTEGER) AS index, step, true AS best FROM range(65) AS r(i), (SELECT unnest([-0.05, 0.05]::DOUBLE[]) AS step) s")
def svm_optimum(spark, sf):
    """Whether a step along any weight (the intercept last) leaves the penalised hinge loss of a linear support vector machine where it is, or raises it; to three decimals."""
    import numpy as np
    import pyarrow as pa
    from pyspark.ml.functions import array_to_vector

    df = vectors(spark, sf).withColumn("y", (F.col("label") < 5).cast("double"))
    rows = df.count()
    # Few tasks for the fit's many passes, all cores for the one look at every step of every row.
    train = model.in_partitions(df.withColumn("features", array_to_vector("features")), {"rows": rows, "inputs": len(NAMES)})
    fitted = model.linear_svm(label="y", rows=rows).fit(train).models[1]  # label 1 against the rest
    weights = [float(w) for w in fitted.coefficients]
    line = np.array([*weights, float(fitted.intercept)])

    def losses(batches):
        for batch in batches:
            x = np.c_[np.stack(batch.column("features").to_numpy(zero_copy_only=False)), np.ones(batch.num_rows)] if batch.num_rows else np.empty((0, len(line)))
            sign = 2 * batch.column("y").to_numpy()[:, None] - 1
            for step in (-0.05, 0.0, 0.05):
                sums = np.maximum(0.0, 1 - sign * ((x @ line)[:, None] + step * x)).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(line)), pa.int32()), pa.array(np.full(len(line), step)), pa.array(sums)], names=["index", "step", "loss"])

    parts = spread(df.select("features", "y")).mapInArrow(losses, "index int, step double, loss double")
    own = F.coalesce(F.get(F.array(*map(F.lit, weights)), F.col("index")), F.lit(0.0))
    penalty = F.when(F.col("index") < len(weights), (2 * F.col("step") * own + F.col("step") * F.col("step")) / (2 * rows)).otherwise(0.0)
    values = parts.groupBy("index", "step").agg((F.sum("loss") / rows).alias("loss")).withColumn("value", F.col("loss") + penalty)
    still = values.where("step = 0").select("index", F.col("value").alias("base"))
    return values.where("step != 0").join(still, "index").select("index", "step", (F.col("value") > F.col("base") - 0.0005).alias("best"))


@query("SELECT CAST(range AS INTEGER) AS index, 0.0 AS gradient FROM range(20)")
def network_gradient(spark, sf):
    """Gradient of the cross entropy at the weights of a trained network, to two decimals: where it stands still it is zero.

    Three inputs, three hidden neurons, two labels: weights of a layer by columns, then its biases.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.ml.functions import array_to_vector

    df = vectors(spark, sf).select((F.col("label") < 5).cast("double").alias("label_index"), F.slice("features", 1, 3).alias("x")).coalesce(1)
    rows = df.count()
    network = model.dense_network(3, 2, "brick", 1, 3, max_iter=400).fit(df.withColumn("features", array_to_vector("x")))
    weights = network.weights.toArray()
    first, shift = weights[:9].reshape(3, 3).T, weights[9:12]
    second, offset = weights[12:18].reshape(3, 2).T, weights[18:20]

    def gradients(batches):
        for batch in batches:
            x = np.stack(batch.column("x").to_numpy(zero_copy_only=False))
            hidden = 1 / (1 + np.exp(-(x @ first.T + shift)))
            out = np.exp(hidden @ second.T + offset)
            error = (out / out.sum(1, keepdims=True) - np.eye(2)[batch.column("label_index").to_numpy().astype(int)]) / rows
            back = error @ second * hidden * (1 - hidden)
            whole = np.concatenate([(back.T @ x).T.ravel(), back.sum(0), (error.T @ hidden).T.ravel(), error.sum(0)])
            yield pa.RecordBatch.from_arrays([pa.array(range(20), pa.int32()), pa.array(whole)], names=["index", "gradient"])

    parts = df.mapInArrow(gradients, "index int, gradient double")
    return parts.groupBy("index").agg((F.round(F.sum("gradient"), 2) + 0.0).alias("gradient"))


@query("SELECT vec_id, true AS same FROM embeddings")
def saved_stage(spark, sf):
    """A fitted pipeline and a selection, saved, loaded and applied to every row beside those in memory."""
    df = vectors(spark, sf)
    path = f"{checkpoint_folder(spark)}/stage-{uuid4().hex}"
    selection = select.fit_selection(df, "label")
    selection.save(spark, f"{path}/selection")
    fitted = model.random_search(
        selection.variants(df)["robust_anova"].withColumn("__split", F.when(F.col("vec_id") % 4 == 0, "val").otherwise("train")), "label", {"lr": {"fit_intercept": [True]}}).model
    model.save_stage(fitted, f"{path}/model")
    kept, loaded = (
        model.predict(stage, taken.variants(df)["robust_anova"], ["vec_id"]).select("vec_id", F.struct("predicted", "probabilities").alias(name))
        for stage, taken, name in ((fitted, selection, "kept"), (model.load_stage(f"{path}/model"), select.Selection.load(spark, f"{path}/selection"), "loaded")))
    return kept.join(loaded, "vec_id").select("vec_id", (F.col("kept") == F.col("loaded")).alias("same"))


@query()
def dense_network(spark, sf):
    from pyspark.ml.functions import array_to_vector

    df = _task(spark, sf).withColumn("features", array_to_vector("features"))
    indexer = model.encode_label(df, "group")
    network = model.dense_network(64, 2, "funnel", 2, 8).fit(indexer.transform(df.where(F.col("__split") == "train")))
    return network.transform(df).select("vec_id", "group", F.element_at(F.array(*[F.lit(v) for v in indexer.labels]), F.col("prediction").cast("int") + 1).alias("predicted"))


SEARCHED = {}  # the search over one corpus that queries on another share


def _cross(spark, sf):
    df = _task(spark, sf)
    first, second = df.where(F.col("__split") != "test"), df.where(F.col("__split") == "test")
    key = (spark.sparkContext.applicationId, sf)
    if key not in SEARCHED:
        selection = select.fit_selection(first, "group")
        SEARCHED[key] = selection, model.random_search(selection.variants(first)["minmax_anova"], "group", GRID)
    return *SEARCHED[key], second


@query()
def cross_corpus_scores(spark, sf):
    selection, search, second = _cross(spark, sf)
    return model.cross_corpus_scores(search, selection, "minmax_anova", second, "group")


@query()
def cross_corpus_trials(spark, sf):
    selection, search, second = _cross(spark, sf)
    out = model.cross_corpus_trials(search, selection, "minmax_anova", second, "group")
    settings = F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ").alias("settings")
    return out.select("kind", settings, *[r6(c).alias(c) for c in ("accuracy", "f1_micro", "f1_macro", "f1_weighted")])


@query(f"""WITH {_X}, w AS (SELECT vec_id, string_agg(CAST(round(v, 4) AS VARCHAR), ',' ORDER BY index) AS s FROM x GROUP BY 1)
           SELECT vec_id, 66 AS width, round((SELECT sum(v) FROM x x2 WHERE x2.vec_id = w.vec_id) + vec_id + 1, 4) AS total FROM w""")
def union_features(spark, sf):
    from pyspark.ml.functions import vector_to_array

    df = vectors(spark, sf)
    sets = {"se": df, "lf": df.select("vec_id", F.array(F.col("vec_id").cast("double"), F.lit(1.0)).alias("features"))}
    joined = model.union_features(sets, "vec_id").select("vec_id", vector_to_array("features").alias("f"))
    return joined.select("vec_id", F.size("f").alias("width"), F.round(F.aggregate("f", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query(f"""WITH {_X} SELECT vec_id, 66 AS width, round(CASE WHEN vec_id % 3 > 0 THEN (SELECT sum(v) FROM x x2 WHERE x2.vec_id = e.vec_id) ELSE -64.0 END
                  + CASE WHEN vec_id % 2 > 0 THEN vec_id + 1 ELSE -2 END, 4) AS total FROM embeddings e""")
def union_features_with_gaps(spark, sf):
    """Two sets that each lack some documents; what is missing is -1."""
    from pyspark.ml.functions import vector_to_array

    df = vectors(spark, sf)
    lf = df.where("vec_id % 2 > 0").select("vec_id", F.array(F.col("vec_id").cast("double"), F.lit(1.0)).alias("features"))
    joined = model.union_features({"se": df.where("vec_id % 3 > 0"), "lf": lf}, "vec_id", df, fill=-1.0).select("vec_id", vector_to_array("features").alias("f"))
    return joined.select("vec_id", F.size("f").alias("width"), F.round(F.aggregate("f", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("""SELECT count(DISTINCT label) AS labels, round(min(w), 6) AS min_weight, round(max(w), 6) AS max_weight, CAST(sum(c) AS BIGINT) AS rows, max(c) AS best_score
          FROM (SELECT label, count(*) AS c, (SELECT count(*) FROM embeddings) / (10.0 * count(*)) AS w FROM embeddings GROUP BY 1)""")
def run_summary(spark, sf):
    df = table(spark, sf, "embeddings")
    out = model.run_summary(df, "label", stats.docs_per_author(df, "label"), "count")
    return out.select("labels", r6("min_weight").alias("min_weight"), r6("max_weight").alias("max_weight"), "rows", "best_score")
