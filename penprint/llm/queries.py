"""The queries of the thirteen operators, with production parameters, over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.llm import audit, chat, decontaminate, digests, edits, html, language, packing, repeats, sharding, simhash, tokenfiles, topk, whitening
from penprint.llm.base import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


BYTES_50K = public_tokenizers.path("byte_bpe_50k.json")
WORDS_49K = public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), WORDS_49K, capacity=4096, end_id=1)


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(23 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query(OP2_SQL)
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.write_chats(chat.format_chats(turns, BYTES_50K)))


@query()
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    # The vocabulary has fewer than 65,536 entries, so two bytes hold an id.
    return tokenfiles.token_files(table(spark, folder, "documents"), WORDS_49K, end_id=2, width=2)


OP3_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, unnest(w) AS word, unnest(range(len(w))) AS pos, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
  UNION ALL
  SELECT 'b', item_id, unnest(w), unnest(range(len(w))), len(w)
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
runs AS (
  SELECT kind, id, pos, n, k, string_agg(word, ' ') OVER (PARTITION BY kind, id, k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS long_run, word
  FROM (SELECT *, 0 AS k FROM words)),
windows AS (
  SELECT DISTINCT id AS item_id, long_run AS run, least(n, 13) AS width FROM runs WHERE kind = 'b' AND pos + least(n, 13) <= n),
sizes AS (SELECT DISTINCT width FROM windows),
spots AS (
  SELECT r.id AS doc_id, r.pos, s.width,
         CASE WHEN s.width = 13 THEN r.long_run ELSE array_to_string(string_split(r.long_run, ' ')[1:s.width], ' ') END AS run
  FROM runs r, sizes s WHERE r.kind = 'd' AND r.pos + s.width <= r.n),
found AS (SELECT p.doc_id, p.pos, p.width, w.item_id FROM spots p JOIN windows w ON p.run = w.run AND p.width = w.width),
hit AS (SELECT doc_id, count(DISTINCT pos + i) AS n_hit FROM (SELECT DISTINCT doc_id, pos, width FROM found), range(13) AS g(i) WHERE i < width GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id),
counts AS (SELECT id, max(n) AS n_words FROM words WHERE kind = 'd' GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) AS contaminated
FROM documents d LEFT JOIN counts c ON c.id = d.doc_id LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""


@query(OP3_SQL)
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.judged(decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


@query()
def op4_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query()
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(~language.is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    found = language.identify(docs, model, carry=["doc_id"])
    return found.select("doc_id", language.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
"""


@query(OP7_SQL)
def op7_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query()
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.summarise(repeats.find_repeats(table(spark, folder, "documents")))
    return found.select("_doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query()
def op9_weighted_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return sharding.assign_shards(docs, sharding.even_tree(8), sharding.even_tree(9))


@query()
def op10_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


@query()
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    model = whitening.fit(vectors, k=4)
    return whitening.component_rows(whitening.transform(vectors, model, carry=["vec_id"]), model, ["vec_id"])


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (
  SELECT w.doc_id, part,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
e AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM e a, e b, e c, e d, e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g AS (SELECT m.*, filter_order, list_min(list_filter(range(1, 6), lambda i: contains(fails, substr(filter_order, i, 1)))) AS gone FROM m, o),
s AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter,
         sum(n) FILTER (gone IS NULL OR gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
         sum(n) FILTER (gone < step AND contains(fails, substr(filter_order, step, 1))) AS redundant, sum(n) FILTER (fails = substr(filter_order, step, 1)) AS unique_fails,
         sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost
  FROM g, range(1, 6) AS r(step) GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM s
"""


@query(OP12_SQL)
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    conditions = audit.quality_conditions(F.coalesce(F.col("text"), F.lit("")))
    return audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"), conditions)


@query()
def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return edits.compare_edits(docs, digests.fit_rarity(docs))
