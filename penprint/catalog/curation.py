"""Queries for sources, filters, joins, selection and order."""

from uuid import uuid4

from pyspark.sql import functions as F

from penprint.catalog.base import query, table
from penprint.functions import lexicon as lx
from penprint.operators import curate
from penprint.session import checkpoint_folder
from penprint.sources import corpus
from penprint.spec import TaskSpec

SPLIT_SQL = "CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END"


def orders_with_split(spark, sf):
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test")
    return table(spark, sf, "orders").withColumn("fixed_split", split)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def read_corpus(spark, sf):
    return corpus.read_corpus(spark, f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def write_corpus(spark, sf):
    """Documents written by language and read back."""
    path = f"{checkpoint_folder(spark)}/corpus-{uuid4().hex}"
    corpus.write_corpus(table(spark, sf, "documents"), path, partition_by=["lang"])
    return corpus.read_corpus(spark, path).select("doc_id", "text", "lang", "source", "n_chars")


@query("SELECT conv_id, turn, role, text FROM conversations")
def csv_corpus(spark, sf):
    """Conversations, with line ends in their texts, written and read as CSV."""
    path = f"{checkpoint_folder(spark)}/csv-{uuid4().hex}"
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    corpus.write_corpus(turns, path, fmt="csv")
    return corpus.read_corpus(spark, path, schema=turns.schema, fmt="csv")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def read_helper(spark, sf):
    path = f"{checkpoint_folder(spark)}/helper-{uuid4().hex}"
    helper = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    corpus.write_corpus(helper, path, fmt="csv")
    return corpus.read_helper(spark, path, helper.schema)


@query("""SELECT 'lang' AS statistic, lang AS value, count(*) AS count FROM documents GROUP BY 2
          UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2""")
def export_counts(spark, sf):
    """Two statistics tables exported as CSV and read back."""
    path, documents = f"{checkpoint_folder(spark)}/counts-{uuid4().hex}", table(spark, sf, "documents")
    corpus.export_counts({c: documents.groupBy(F.col(c).alias("value")).count() for c in ("lang", "source")}, path)
    back = [corpus.read_helper(spark, f"{path}/{c}", "value string, count long").select(F.lit(c).alias("statistic"), "value", "count") for c in ("lang", "source")]
    return back[0].unionAll(back[1])


@query("""SELECT o_orderkey, o_custkey FROM orders
          WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1997-03-01'""")
def date_range(spark, sf):
    return corpus.date_range(table(spark, sf, "orders"), "o_orderdate", "1996-03-01", "1997-02-28").select("o_orderkey", "o_custkey")


@query("SELECT event_id, user_id, value FROM events WHERE event_type IN ('view', 'click')")
def source_fields(spark, sf):
    return corpus.source_fields(table(spark, sf, "events"), ["event_id", "user_id", "value"], "event_type", ["view", "click"])


@query("""SELECT vec_id, string_agg(CAST(CAST(round(v::DOUBLE, 5) * 100000 AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS packed
          FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id""")
def round_features(spark, sf):
    rounded = corpus.round_features(F.col("embedding").cast("array<double>"), 5)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.array_join(F.transform(rounded, lambda v: F.round(v * 100000).cast("long")), ",").alias("packed"))


@query(f"""SELECT {SPLIT_SQL} AS fixed_split, o_custkey, CAST(0 AS INTEGER) AS part,
                  string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY md5('0:' || o_orderkey)) AS ids,
                  string_agg(o_orderpriority, '|' ORDER BY md5('0:' || o_orderkey)) AS texts
           FROM orders GROUP BY 1, 2""")
def author_documents(spark, sf):
    out = corpus.author_documents(orders_with_split(spark, sf), "fixed_split", "o_custkey", "o_orderkey", "o_orderpriority")
    return out.select("fixed_split", "o_custkey", "part", F.array_join("ids", ",").alias("ids"), F.array_join("texts", "|").alias("texts"))


@query("""SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority,
                 arg_min(o_orderstatus, o_orderkey) FILTER (WHERE o_orderstatus IS NOT NULL) AS o_orderstatus
          FROM orders GROUP BY 1""")
def export_truth(spark, sf):
    return corpus.export_truth(table(spark, sf, "orders"), "o_custkey", "o_orderkey", ["o_orderpriority", "o_orderstatus"])


@query("""SELECT d.doc_id, d.text, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS predicted, quality AS actual
          FROM documents d JOIN labels l USING (doc_id)""")
def prediction_table(spark, sf):
    documents = table(spark, sf, "documents")
    predicted = documents.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("predicted"), F.col("quality").alias("actual"))
    return corpus.prediction_table(documents, predicted, "doc_id", "text")


@query("""SELECT 'length' AS features, doc_id, round(1.0 / (1 + n_chars), 6) AS good, round(1 - 1.0 / (1 + n_chars), 6) AS bad,
                 source AS label FROM documents""")
def probability_table(spark, sf):
    documents = table(spark, sf, "documents")
    p = F.array(F.lit(1.0) / (1 + F.col("n_chars")))
    out = corpus.probability_table(documents, p, ["good", "bad"], "length", "doc_id", "source")
    return out.withColumns({"good": F.round("good", 6), "bad": F.round("bad", 6)})


@query(f"SELECT o_orderkey, o_orderpriority AS label, {SPLIT_SQL} AS __split FROM orders")
def task_view(spark, sf):
    spec = TaskSpec("priority", "o_orderpriority", "fixed_split")
    return curate.task_view(orders_with_split(spark, sf), spec).select("o_orderkey", "label", "__split")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'")
def select_split(spark, sf):
    return curate.select_split(orders_with_split(spark, sf), "val", "fixed_split").select("o_orderkey", "o_custkey")


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NOT NULL")
def drop_unlabelled(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return curate.drop_unlabelled(joined, "quality").select("doc_id", "quality")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def drop_unsplit(spark, sf):
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val")
    return curate.drop_unsplit(table(spark, sf, "orders").withColumn("s", split), "s").select("o_orderkey", "o_orderstatus")


@query(r"""SELECT doc_id FROM documents
           WHERE NOT regexp_matches(text, '((a través de|v[íi]a)) @+[\[A-Za-zÑñ\d_]+\n?\z|\||#endirecto')""")
def drop_syndicated(spark, sf):
    return curate.drop_syndicated(table(spark, sf, "documents"), "text").select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE lang = 'es'")
def keep_language(spark, sf):
    return curate.keep_language(table(spark, sf, "documents"), "lang").select("doc_id", "source")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def min_documents(spark, sf):
    return curate.min_documents(table(spark, sf, "orders"), "o_custkey", 12).select("o_orderkey", "o_custkey")


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)' || (SELECT string_agg(DISTINCT replace(p_name, ' ', '\s?'), '|') FROM part) || '|the\s?and') AS is_relevant
           FROM documents""")
def flag_topic(spark, sf):
    topics = table(spark, sf, "part").select(F.col("p_name").alias("a"), F.lit("the and").alias("b")).distinct()
    return curate.flag_topic(table(spark, sf, "documents"), "text", topics).select("doc_id", "is_relevant")


@query("""SELECT c_custkey, CASE WHEN c_acctbal <= 0 OR c_acctbal > 999 THEN NULL WHEN c_acctbal <= 13 THEN '0-12' WHEN c_acctbal <= 18 THEN '13-17'
                 WHEN c_acctbal <= 25 THEN '18-24' WHEN c_acctbal <= 35 THEN '25-34' WHEN c_acctbal <= 50 THEN '35-49'
                 WHEN c_acctbal <= 65 THEN '50-64' ELSE 'over-65' END AS age_range FROM customer""")
def bin_range(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", curate.bin_range(F.col("c_acctbal")).alias("age_range"))


@query("""SELECT doc_id, CASE WHEN quality IN (1) THEN 'left' ELSE 'right' END AS side FROM documents LEFT JOIN labels USING (doc_id)""")
def map_membership(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select("doc_id", curate.map_membership(F.col("quality"), [1]).alias("side"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'industry' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'home' END AS sector
          FROM customer""")
def map_groups(spark, sf):
    groups = {"industry": ["BUILDING", "MACHINERY"], "home": ["HOUSEHOLD"]}
    return table(spark, sf, "customer").select("c_custkey", curate.map_groups(F.col("c_mktsegment"), groups).alias("sector"))


@query("""SELECT doc_id, coalesce(text, '') AS text, CAST(quality AS VARCHAR) AS quality FROM documents LEFT JOIN labels USING (doc_id)""")
def normalise_types(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return curate.normalise_types(joined, ["text", "absent"], ["quality"]).select("doc_id", "text", "quality")


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS label_index FROM orders")
def encode_label(spark, sf):
    from penprint.operators.model import encode_label as encode

    orders = table(spark, sf, "orders")
    return encode(orders, "o_orderpriority").transform(orders).select("o_orderkey", "label_index")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_returnflag = 'A' AS INTEGER) AS l_returnflag_A, CAST(l_returnflag = 'N' AS INTEGER) AS l_returnflag_N,
                 CAST(l_returnflag = 'R' AS INTEGER) AS l_returnflag_R FROM lineitem""")
def one_hot(spark, sf):
    out = curate.one_hot(table(spark, sf, "lineitem"), "l_returnflag", ["A", "N", "R"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R")


@query("""SELECT doc_id, CAST(lang = 'en' AS INTEGER) AS tags_en, CAST(lang = 'es' AS INTEGER) AS tags_es, CAST(source = 'src1' AS INTEGER) AS tags_src1
          FROM documents""")
def multi_hot(spark, sf):
    tagged = table(spark, sf, "documents").withColumn("tags", F.concat_ws("; ", "lang", "source"))
    return curate.multi_hot(tagged, "tags", ["en", "es", "src1"]).select("doc_id", "tags_en", "tags_es", "tags_src1")


@query('SELECT doc_id, n_chars AS "size-chars", length(source) AS "size-source" FROM documents')
def columns_by_category(spark, sf):
    wide = table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").alias("size-chars"), F.length("source").cast("long").alias("size-source"), F.lit(1).alias("other-one"))
    return curate.columns_by_category(wide, "size", ["doc_id"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '5-LOW'")
def project_final(spark, sf):
    df = table(spark, sf, "orders").withColumn("a", F.when(F.col("o_orderstatus") == "F", "train")).withColumn(
        "b", F.when(F.col("o_orderpriority") == "5-LOW", "val"))
    return curate.project_final(df, ["o_orderkey", "o_custkey"], ["a", "b"])


# --- Joins ---------------------------------------------------------------------------
@query("SELECT o_orderkey, o_custkey, c_mktsegment AS affiliation, c_acctbal AS age FROM orders JOIN customer ON c_custkey = o_custkey")
def attach_author_traits(spark, sf):
    out = curate.attach_author_traits(
        table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey", {"c_mktsegment": "affiliation", "c_acctbal": "age"})
    return out.select("o_orderkey", "o_custkey", "affiliation", "age")


@query("SELECT o_orderkey, c_mktsegment AS o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey")
def relabel(spark, sf):
    labels = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("o_orderpriority"))
    return curate.relabel(table(spark, sf, "orders"), labels, "o_custkey", ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join(spark, sf):
    return curate.semi_join(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, sf):
    return curate.anti_join(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT count(*) AS documents, count(*) FILTER (WHERE quality IS NULL) AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def align_features(spark, sf):
    aligned = curate.align_features(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
    return curate.missing_features(aligned, "quality")


@query("SELECT doc_id, source, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def aligned_table(spark, sf):
    aligned = curate.align_features(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
    return aligned.select("doc_id", "source", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("quality", "toxic")])


# --- Selection and order ---------------------------------------------------------------
@query("""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey, month(o_orderdate)
                            ORDER BY CAST(o_orderpriority = '1-URGENT' AS INTEGER) DESC, o_totalprice DESC, o_orderkey) AS rn FROM orders),
               b AS (SELECT *, count(*) OVER (PARTITION BY o_custkey ORDER BY rn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
          SELECT o_orderkey, o_custkey FROM b WHERE before < 8""")
def balanced_month_sample(spark, sf):
    urgent = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    return curate.balanced_month_sample(
        table(spark, sf, "orders"), "o_custkey", "o_orderdate", urgent, F.col("o_totalprice"), ["o_orderkey"], maximum=8,
    ).select("o_orderkey", "o_custkey")


@query("""SELECT o_custkey, '@user' || row_number() OVER (ORDER BY md5('7:' || o_custkey)) AS mask FROM (SELECT DISTINCT o_custkey FROM orders)""")
def number_authors(spark, sf):
    return curate.number_authors(table(spark, sf, "orders"), "o_custkey", seed=7)


@query("""SELECT d.doc_id, text || ' ' || mask || ' x' || mask || ', @' || source || 'x' AS text FROM documents d JOIN (
            SELECT source, '@user' || row_number() OVER (ORDER BY md5('0:' || source)) AS mask FROM (SELECT DISTINCT source FROM documents)) USING (source)""")
def mask_handles(spark, sf):
    """Every text followed by its source as a handle, in capitals and inside a word, and by a longer handle that stays."""
    documents = table(spark, sf, "documents")
    said = F.concat("text", F.lit(" @"), F.upper("source"), F.lit(" x@"), "source", F.lit(", @"), "source", F.lit("x"))
    masks = curate.number_authors(documents, "source")
    return curate.mask_handles(documents.withColumn("text", said), "doc_id", "text", masks, "source").select("doc_id", "text")


@query("""SELECT d.doc_id, n.mask AS label FROM documents d JOIN (SELECT source, '@user' || row_number() OVER (ORDER BY md5('0:' || source)) AS mask
          FROM (SELECT DISTINCT source FROM documents)) n USING (source)""")
def mask_author(spark, sf):
    documents = table(spark, sf, "documents")
    return curate.mask_author(documents, "source", curate.number_authors(documents, "source")).select("doc_id", "label")


@query("SELECT user_id, event_id, value FROM events ORDER BY user_id, ts, event_id")
def sort_by_author(spark, sf):
    return curate.sort_by_author(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("SELECT doc_id, source FROM documents ORDER BY md5('3:' || doc_id), doc_id")
def shuffle_documents(spark, sf):
    return curate.shuffle_documents(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", seed=3)
