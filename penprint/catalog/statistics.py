"""Queries for counts, distributions, profiles and merging by author."""

from pyspark.sql import functions as F

from penprint.catalog.base import query, r6, table
from penprint.catalog.cleaning import CLEAN_SQL, written
from penprint.catalog.curation import SPLIT_SQL, orders_with_split
from penprint.operators import merge, stats


@query("SELECT source, count(*) AS count FROM documents GROUP BY 1")
def docs_per_author(spark, sf):
    return stats.docs_per_author(table(spark, sf, "documents"), "source")


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count FROM orders GROUP BY 1, 2")
def docs_per_author_month(spark, sf):
    return stats.docs_per_author_month(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


@query("SELECT source, lang, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2")
def docs_per_author_language(spark, sf):
    return stats.docs_per_author_language(table(spark, sf, "documents"), "source", "lang")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share
          FROM orders GROUP BY 1, 2""")
def label_distribution(spark, sf):
    return stats.label_distribution(table(spark, sf, "orders"), "o_orderpriority", ["o_orderstatus"]).withColumn("share", r6("share"))


@query("SELECT user_id, count(*) AS count, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def value_distribution(spark, sf):
    return stats.value_distribution(table(spark, sf, "events"), "user_id").withColumn("share", r6("share"))


@query("""SELECT label, count(*) AS count FROM (SELECT unnest(string_split(p_name || '; ' || p_type, '; ')) AS label FROM part) GROUP BY 1""")
def multi_label_distribution(spark, sf):
    tagged = table(spark, sf, "part").withColumn("tags", F.concat_ws("; ", "p_name", "p_type"))
    return stats.multi_label_distribution(tagged, "tags")


@query("SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders")
def date_bounds(spark, sf):
    return stats.date_bounds(table(spark, sf, "orders"), "o_orderdate").select(
        F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"))


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS count FROM lineitem GROUP BY 1")
def docs_per_month(spark, sf):
    return stats.docs_per_month(table(spark, sf, "lineitem"), "l_shipdate")


_DESCRIBE = """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
    max({c})::DOUBLE AS max, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50,
    round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75 FROM {t}"""


def _rounded(df):
    return df.withColumns({c: r6(c) for c in ("mean", "std", "q25", "q50", "q75")})


@query(" UNION ALL ".join(_DESCRIBE.format(c=c, t="lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe_numeric(spark, sf):
    return _rounded(stats.describe_numeric(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query(f"WITH cleaned AS (SELECT length({CLEAN_SQL}) AS length FROM part) {_DESCRIBE.format(c='length', t='cleaned')}")
def length_profile(spark, sf):
    return _rounded(stats.length_profile(written(spark, sf), "text"))


@query(f"""WITH c AS (SELECT {SPLIT_SQL} AS split, 'o_orderpriority' AS "column", o_orderpriority AS value FROM orders
                UNION ALL SELECT {SPLIT_SQL}, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders)
           SELECT "column", split, value, count(*) AS count FROM c GROUP BY ALL
           UNION ALL SELECT "column", 'all', value, count(*) FROM c GROUP BY ALL""")
def categorical_profile(spark, sf):
    return stats.categorical_profile(orders_with_split(spark, sf), ["o_orderpriority", "o_custkey"], "fixed_split")


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def available_labels(spark, sf):
    return stats.available_labels(orders_with_split(spark, sf), "o_orderpriority", "fixed_split")


@query("SELECT count(DISTINCT o_custkey) AS labels FROM orders WHERE o_orderstatus = 'F'")
def num_labels(spark, sf):
    return stats.num_labels(orders_with_split(spark, sf), "o_custkey", "fixed_split")


@query("""SELECT round(stddev_samp(s), 6) AS deviation, stddev_samp(s) > 0.15 AS imbalanced
          FROM (SELECT count(*) / sum(count(*)) OVER () AS s FROM labels GROUP BY quality)""")
def is_imbalanced(spark, sf):
    return stats.is_imbalanced(table(spark, sf, "labels"), "quality").withColumn("deviation", r6("deviation"))


@query("""WITH c AS (SELECT count(*)::DOUBLE AS n FROM orders GROUP BY o_custkey), m AS (SELECT quantile_cont(n, 0.5) AS med FROM c)
          SELECT CAST(round_even(quantile_cont(abs(n - med), 0.5) / (2 / sqrt(3)), 0) AS BIGINT) AS mad FROM c, m""")
def author_mad(spark, sf):
    return stats.author_mad(table(spark, sf, "orders"), "o_custkey")


@query("""SELECT quality, round((SELECT count(*) FROM labels) / (count(*) OVER () * count(*)), 6) AS weight FROM labels GROUP BY quality""")
def class_weights(spark, sf):
    return stats.class_weights(table(spark, sf, "labels"), "quality").withColumn("weight", r6("weight"))


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS e, count(*) FILTER (WHERE source = 'src1') AS s FROM documents)
          SELECT doc_id, round((CASE WHEN lang = 'en' THEN n / (2.0 * e) ELSE n / (2.0 * (n - e)) END)
                               * (CASE WHEN source = 'src1' THEN n / (2.0 * s) ELSE n / (2.0 * (n - s)) END), 6) AS weight FROM documents, c""")
def sample_weights(spark, sf):
    tagged = table(spark, sf, "documents").withColumn("tags", F.concat_ws("; ", "lang", "source"))
    return stats.sample_weights(tagged, "tags", ["en", "src1"]).select("doc_id", r6("weight").alias("weight"))


@query("SELECT round(ln(min(c) / max(c)), 6) AS log_odds FROM (SELECT count(*) AS c FROM labels GROUP BY toxic)")
def initial_log_odds(spark, sf):
    return stats.initial_log_odds(table(spark, sf, "labels"), "toxic").select(r6("log_odds").alias("log_odds"))


@query("SELECT min(c) AS documents FROM (SELECT count(*) AS c FROM events GROUP BY user_id)")
def smallest_group(spark, sf):
    return stats.smallest_group(table(spark, sf, "events"), "user_id")


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_values(spark, sf):
    return stats.distinct_values(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag")


# --- Merging by author --------------------------------------------------------------------
@query("""SELECT conv_id, CAST(0 AS INTEGER) AS part, string_agg(text, ' [SEP] ' ORDER BY turn) AS text, string_agg(role, ' [SEP] ' ORDER BY turn) AS role
          FROM conversations GROUP BY conv_id""")
def merge_by_author(spark, sf):
    return merge.merge_by_author(table(spark, sf, "conversations"), ["conv_id"], ["text", "role"], ["turn"])


@query("""SELECT label, i AS index, round(avg(v), 6) AS mean FROM
          (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2""")
def merge_features_by_author(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumn("features", F.col("embedding").cast("array<double>")).withColumn("s", F.lit("train"))
    merged = merge.merge_features_by_author(vectors, "label", split="s")
    return merged.select("label", F.posexplode("features").alias("index", "mean")).select("label", F.col("index").cast("long").alias("index"), r6("mean").alias("mean"))


@query("""SELECT o_custkey, arg_min(o_orderpriority, (-c, o_orderpriority)) AS o_orderpriority
          FROM (SELECT o_custkey, o_orderpriority, count(*) AS c FROM orders GROUP BY 1, 2) GROUP BY 1""")
def vote_by_author(spark, sf):
    return merge.vote_by_author(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")
