"""Queries for splits and samples."""

from pyspark.sql import functions as F

from penprint.catalog.base import query, table
from penprint.catalog.curation import SPLIT_SQL, orders_with_split
from penprint.operators import split


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id)) - 1 AS i, count(*) OVER () AS n FROM documents)
          SELECT doc_id, CASE WHEN i < floor(0.6::DOUBLE * n) THEN 'train' WHEN i < floor(0.8::DOUBLE * n) THEN 'val' ELSE 'test' END AS __split FROM r""")
def random_split(spark, sf):
    return split.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


_FOLDS = range(1, 11)


@query(f"""WITH o AS (SELECT o_orderkey, {SPLIT_SQL} AS s FROM orders),
                p AS (SELECT *, count(*) OVER () AS n, {", ".join(f"row_number() OVER (ORDER BY md5('{i}:' || o_orderkey)) - 1 AS i{i}" for i in _FOLDS)}
                      FROM o WHERE s IN ('train', 'val'))
           SELECT o_orderkey, {", ".join(f"CASE WHEN i{i} < floor((0.6::DOUBLE / (0.6::DOUBLE + 0.2::DOUBLE)) * n) THEN 'train' ELSE 'val' END AS __split_fold_{i}" for i in _FOLDS)}
           FROM p UNION ALL SELECT o_orderkey, {", ".join(["'test'"] * 10)} FROM o WHERE s = 'test'""")
def repeated_folds(spark, sf):
    orders = orders_with_split(spark, sf).select("o_orderkey", "fixed_split")
    return split.repeated_folds(orders, "o_orderkey", split="fixed_split").drop("fixed_split")


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
          WHERE rn <= 5""")
def head_per_author(spark, sf):
    return split.head_per_author(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 5).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, CASE WHEN rn <= 3 THEN 'val' ELSE 'test' END AS __split
          FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('0:' || o_orderkey), o_orderkey) AS rn FROM orders) WHERE rn <= 6""")
def sample_per_author(spark, sf):
    return split.sample_per_author(table(spark, sf, "orders"), "o_custkey", "o_orderkey", n=6).select("o_orderkey", "__split")


@query("SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) < 6")
def short_authors(spark, sf):
    return split.short_authors(table(spark, sf, "orders"), "o_custkey", 6)


@query("SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 166")
def top_authors(spark, sf):
    return split.top_authors(table(spark, sf, "orders"), "o_custkey")


_AUTHORS = """counts AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
     ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) AS place FROM counts),
     rest AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('0:' || o_custkey)) - 1 AS i, count(*) OVER () AS m FROM ranked WHERE place > 166),
     named AS (SELECT o_custkey, CASE WHEN i < round_even(0.5 * m, 0) THEN 'val' ELSE 'test' END AS __split FROM rest
               UNION ALL SELECT o_custkey, 'train' FROM ranked WHERE place <= 166),
     placed AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)"""


@query(f"""WITH {_AUTHORS} SELECT o_orderkey, o_custkey, __split FROM placed JOIN named USING (o_custkey) WHERE rn <= (SELECT min(n) FROM counts)""")
def author_disjoint_split(spark, sf):
    return split.author_disjoint_split(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "__split")


@query(f"""WITH {_AUTHORS}, t AS (SELECT * FROM placed JOIN named USING (o_custkey) WHERE __split = 'train'),
               u AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('0:' || o_orderkey), o_orderkey) AS k FROM t
                     WHERE rn > (SELECT min(n) FROM counts))
           SELECT o_orderkey, o_custkey, 'train' AS __split FROM t WHERE rn <= (SELECT min(n) FROM counts)
           UNION ALL SELECT o_orderkey, o_custkey, CASE WHEN k <= 4 THEN 'val' ELSE 'test' END FROM u WHERE k <= 8""")
def author_attribution_split(spark, sf):
    return split.author_attribution_split(
        table(spark, sf, "orders"), "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"], n=8,
    ).select("o_orderkey", "o_custkey", "__split")


@query(f"SELECT o_orderkey, CASE WHEN {SPLIT_SQL} = 'train' THEN -1 ELSE 0 END AS fold FROM orders WHERE {SPLIT_SQL} <> 'test'")
def predefined_split_index(spark, sf):
    pool = split.train_and_val(orders_with_split(spark, sf), "fixed_split")
    return pool.select("o_orderkey", split.predefined_split_index(F.col("fixed_split")).alias("fold"))


@query(f"SELECT o_orderkey, {SPLIT_SQL} AS fixed_split FROM orders WHERE o_orderstatus IN ('F', 'O')")
def train_and_val(spark, sf):
    return split.train_and_val(orders_with_split(spark, sf), "fixed_split").select("o_orderkey", "fixed_split")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3")
def labels_in_every_split(spark, sf):
    return split.labels_in_every_split(orders_with_split(spark, sf), "o_custkey", "fixed_split")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def id_difference(spark, sf):
    return split.id_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
