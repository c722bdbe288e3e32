"""What must and must not be in the plans."""

from pyspark.sql import functions as F

from penprint.catalog import QUERIES
from penprint.functions import text as t
from penprint.functions.order import FREQUENT, split_join
from penprint.operators import curate
from penprint.session import stored

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_is_one_projection_in_the_jvm(spark):
    shown = plan(t.add_clean_columns(spark.read.parquet(f"{FOLDER}/documents.parquet"), "text"))
    assert "Python" not in shown and "Exchange" not in shown


def test_limits_come_before_the_shuffle(spark):
    shown = plan(QUERIES["balanced_month_sample"](spark, FOLDER))
    # The plan is printed from the result down to the scan.
    assert shown.rindex("WindowGroupLimit") > shown.rindex("Exchange")


def test_a_frequent_author_is_limited_before_it_is_gathered(spark):
    """With names that are too many to broadcast, documents meet them in slices, and the limit comes before the author-only shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 400).cast("string")).alias("author"), F.current_timestamp().alias("ts"))
        kept = curate.min_documents(rows, "author", 5)
        shown = plan(curate.balanced_month_sample(kept, "author", "ts", F.lit(1), F.col("id"), ["id"], maximum=8))
        join = shown.index("SortMergeJoin")
        assert "_slice" in shown[join:] and "Exchange" in shown[:join]
        assert shown.rindex("WindowGroupLimit", 0, join) > shown.rindex("Exchange", 0, join)
        assert kept.where("author = 'hot'").count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_rows_of_frequent_keys_are_repeated(spark):
    """A third of the rows has one key and the rest 2,000: the side with one row per key grows by the slices of that one."""
    rows = spark.range(30000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 2000).alias("key"))
    counts = stored(rows.groupBy("key").count())
    joined = split_join(rows, counts.select("key", (F.col("key") + 1).alias("next")), ["key"], counts)
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert joined.count() == 30000 and joined.where("next != key + 1").count() == 0
    frequent = counts.where(F.col("count") * FREQUENT > 30000)
    assert [r["key"] for r in frequent.collect()] == [-1]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = split_join(rows, counts.select("key"), ["key"], counts)
        again.collect()
        table = again._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    made = []

    def walk(node):
        if node.nodeName().startswith("Generate"):
            made.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(table)
    assert made and all(n <= counts.count() + tasks for n in made), made


def test_splitting_needs_no_shuffle(spark):
    assert "Exchange" not in plan(QUERIES["random_split"](spark, FOLDER))


def test_only_needed_columns_are_read(spark):
    shown = plan(QUERIES["docs_per_author"](spark, FOLDER))
    assert "ReadSchema: struct<source:string>" in shown


def test_no_pairs_without_a_key(spark):
    heavy = {"random_search", "predict_labels", "predictions_are_likeliest", "dense_network", "network_gradient", "svm_optimum", "saved_stage", "cross_corpus_scores", "cross_corpus_trials", "experiment_report", "compile_corpus", "compile_orders", "reduce_svd", "svd_traces", "char_tfidf",
             "detect_language", "word_tfidf", "top_terms"}
    for name, query in QUERIES.items():
        if name not in heavy:
            shown = plan(query(spark, FOLDER))
            assert "CartesianProduct" not in shown and "NestedLoop" not in shown, name


def test_plan_size_does_not_follow_the_topics(spark):
    from penprint.operators.topics import flag_topic

    texts = spark.range(5).selectExpr("id", "concat('text ', id) AS t")
    sizes = [len(plan(flag_topic(texts, "t", spark.range(n).selectExpr("concat('topic ', id) AS a")))) for n in (10, 3000)]
    assert abs(sizes[0] - sizes[1]) < 200


def test_filters_are_pushed(spark):
    shown = plan(curate.keep_language(spark.read.parquet(f"{FOLDER}/documents.parquet"), "lang").select("doc_id"))
    assert "EqualTo(lang,es)" in shown


def test_cleaners_work_on_streams(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(FOLDER)
    out = t.clean(curate.drop_syndicated(stream, "text"), "text").withColumn("words", t.word_count(F.col("text")))
    assert out.isStreaming and out.columns[-1] == "words"
