"""What a query reads, and on how many cores, stays in step with its input."""

import random

from pyspark.sql import functions as F

from penprint.catalog.cleaning import written
from penprint.catalog.selection import svm_optimum
from penprint.operators import ensemble, features, stats


def seen(df, counter):
    """``df``, with every row that is worked out added to a counter."""
    def rows(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    return df.mapInArrow(rows, df.schema)


def test_lengths_are_cleaned_once(spark):
    texts = spark.range(50).select(F.concat(F.lit("hola  "), F.col("id").cast("string"), F.repeat(F.lit("x"), F.col("id").cast("int") % 2)).alias("text"))
    counter = spark.sparkContext.accumulator(0)
    found = stats.length_profile(seen(texts, counter), "text").first()
    assert (found["count"], counter.value) == (50, 50)


def test_written_texts_use_all_cores(spark, tmp_path):
    parts = spark.range(40).select((F.col("id") + 1).alias("p_partkey"), F.lit("peel salmon").alias("p_name"), F.lit(7).alias("p_size"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = written(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows.count() == 40


def test_steps_of_the_svm_are_not_looked_at_in_one_task(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.random() + (j == i % 10) for j in range(64)], i % 10) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = svm_optimum(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Repartition 1," not in plan
    assert sorted((r["index"], r["step"], r["best"]) for r in found.collect()) == [(i, s, True) for i in range(65) for s in (-0.05, 0.05)]


def test_words_of_sequences_are_looked_up_inside_tasks(spark, monkeypatch):
    texts = spark.createDataFrame(
        [(1, "b a b"), (2, "a, c; b"), (3, None), (2, "d a zz yy xx ww vv"), (None, "a"), (4, "  ")], "id long, text string")
    vocabulary = features.fit_vocabulary(texts.where("text is null or text not like '%zz%'"), "text")
    numbered = {r["token"]: (r["index"], r["count"], r["documents"]) for r in vocabulary.table.collect()}
    assert numbered == {"a": (2, 3, 3), "b": (3, 3, 2), "c": (4, 1, 1)} and (vocabulary.documents, vocabulary.maxlen) == (5, 3)
    sequences = features.to_sequences(texts, "id", "text", vocabulary)
    plan = sequences._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    # Rows of one id are one document, their tokens by place; the second of id 2 keeps its last three, which are unknown.
    wanted = {1: [3, 2, 3], 2: [1, 2, 1, 4, 1, 3], 3: [0, 0, 0], 4: [0, 0, 0], None: [0, 0, 2]}
    assert {r["id"]: r["tokens"] for r in sequences.collect()} == wanted
    monkeypatch.setattr(features, "HELD_WORDS", 1)  # the others are joined
    assert {r["id"]: r["tokens"] for r in features.to_sequences(texts, "id", "text", vocabulary).collect()} == wanted
    bounded = features.Vocabulary(vocabulary.table, vocabulary.documents, vocabulary.maxlen, num_words=4)
    assert {r["id"]: r["tokens"] for r in features.to_sequences(texts.where("id = 2 and text like 'a%'"), "id", "text", bounded).collect()} == {2: [2, 1, 3]}


def test_documents_of_an_ensemble_are_dealt_by_their_rows(spark, monkeypatch):
    cells = spark.range(4000).select((F.col("id") % 400).alias("id"), F.concat(F.lit("l"), (F.col("id") % 3).cast("string")).alias("label"), (F.col("id") % 7 / 7.0).alias("p"))
    whole = {r["id"]: r["predicted"] for r in ensemble.ensemble_mean(cells, "id").collect()}
    monkeypatch.setattr(ensemble, "DEALT", 100)
    found = ensemble.ensemble_mean(cells, "id")
    assert found.rdd.getNumPartitions() == 41
    assert {r["id"]: r["predicted"] for r in found.collect()} == whole and len(whole) == 400


def test_languages_are_detected_once_however_often_they_are_read(spark):
    texts = spark.createDataFrame([(1, "the dog and the cat", "en"), (2, "el perro y el gato", "es"), (3, "the cat", "en")], "id long, text string, lang string")
    found = features.detect_language(texts, "id", "text", features.fit_language_profiles(texts, "text", "lang"), threshold=0.0)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: r["language"] for r in found.collect()} == {1: "en", 2: "es", 3: "en"}
