"""Queries for text features, vocabularies, vectors and language."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from penprint.catalog.base import query, r6, table, texts
from penprint.functions import lexicon as lx
from penprint.operators import features
from penprint.operators.reduction import fit_sparse_svd
from penprint.session import stored

_W = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}')"
_WORD_GRAMS = f"""w AS (SELECT doc_id, {_W} AS t FROM documents),
    g AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]),
             list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS term FROM w)"""
_CHARS = r"""c AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[\s\x0b][\s\x0b]+', ' ', 'g'), '') AS t FROM documents),
    g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, len(t) - 1), lambda i: t[i] || t[i + 1] || t[i + 2]),
             list_transform(range(1, len(t) - 2), lambda i: t[i] || t[i + 1] || t[i + 2] || t[i + 3]),
             list_transform(range(1, len(t) - 3), lambda i: t[i] || t[i + 1] || t[i + 2] || t[i + 3] || t[i + 4]))) AS term FROM c)"""
_FIT = """tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
    v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= {min_df} ORDER BY total DESC, term LIMIT 100),
    vocabulary AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS index, CAST(total AS BIGINT) AS total, df,
                   ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM v),
    raw AS (SELECT doc_id, term, index, {weight} * idf AS w FROM tf JOIN vocabulary USING (term)),
    weights AS (SELECT doc_id, term, index, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""
_SUBLINEAR = _FIT.format(min_df=2, weight="(1 + ln(tf))")
_SHOW = "SELECT doc_id, term, CAST(index AS BIGINT) AS index, round(weight, 6) AS weight FROM weights"


def _weights(fitted, df):
    out = fitted.weights(df, "doc_id", "text")
    return out.select("doc_id", "term", F.col("index").cast("long").alias("index"), r6("weight").alias("weight"))


@query(f"WITH {_WORD_GRAMS}, {_SUBLINEAR} {_SHOW}")
def word_tfidf(spark, sf):
    documents = texts(spark, sf)
    return _weights(features.word_tfidf(documents, "text"), documents)


@query(f"WITH {_CHARS}, {_SUBLINEAR} {_SHOW}")
def char_tfidf(spark, sf):
    documents = texts(spark, sf)
    return _weights(features.char_tfidf(documents, "text"), documents)


@query()
def reduce_svd(spark, sf):
    documents = texts(spark, sf)
    reduced = features.reduce_svd(documents.where(F.col("lang") != "de"), documents, "doc_id", "text")
    return reduced.select("doc_id", *[F.get("features", F.lit(i)).alias(f"ng_{i}") for i in range(100)])


@query(f"""WITH {_WORD_GRAMS}, {_SUBLINEAR},
           pairs AS (SELECT a.index AS i, b.index AS j, sum(a.weight * b.weight) AS dot FROM weights a JOIN weights b USING (doc_id) GROUP BY 1, 2)
           SELECT CAST(100 AS BIGINT) AS directions, round(sum(dot) FILTER (i = j), 6) AS squares, round(sum(dot * dot), 4) AS fourths FROM pairs""")
def svd_traces(spark, sf):
    """Sums of the second and fourth powers of the singular values of the weighted words: the trace of their products, and of its square."""
    documents = texts(spark, sf)
    cells, width = features.ngram_cells(documents, "doc_id", "text", [features.word_tfidf(documents, "text")])
    fitted = fit_sparse_svd(stored(cells), width)
    projected = fitted.transform(cells, "doc_id").select(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x).alias("s"))
    powers = projected.agg(F.sum("s").alias("squares"))
    fourths = float((fitted.values ** 4).sum())
    return powers.select(F.lit(fitted.directions.shape[1]).cast("long").alias("directions"), r6("squares").alias("squares"), F.round(F.lit(fourths), 4).alias("fourths"))


@query(f"""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
           SELECT CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j, CASE WHEN a.range = b.range THEN 1.0 ELSE 0.0 END AS dot, a.range = b.range AS same,
                  (SELECT round(sum(v * v), 4) FROM x) AS energy FROM range(64) a, range(64) b""")
def svd_basis(spark, sf):
    """All directions of a decomposition are of unit length and at right angles, and keep the squared length of the vectors."""
    df = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fitted = features.fit_svd(df.withColumn("v", array_to_vector("v")), "v", 64)
    energy = fitted.transform(df.withColumn("v", array_to_vector("v")), "v").agg(
        F.round(F.sum(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("energy"))
    size = len(fitted.components)
    cells = [(i, j, sum(r[i] * r[j] for r in fitted.components)) for i in range(64) for j in range(64)] if size else []
    dots = spark.createDataFrame(cells, "i int, j int, dot double")
    return dots.select("i", "j", (r6("dot") + 0.0).alias("dot"), (F.col("i") == F.col("j")).alias("same")).withColumn("energy", energy.scalar())


@query(rf"""WITH stop AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' the and la le der'), ' ')) AS term FROM part), w AS (SELECT doc_id, unnest({_W}) AS term FROM documents),
            g AS (SELECT * FROM w WHERE term NOT IN (SELECT term FROM stop)), {_FIT.format(min_df=1, weight="tf")}
            SELECT term, round(sum(weight), 6) AS weight FROM weights GROUP BY 1""")
def top_terms(spark, sf):
    stop = table(spark, sf, "part").select(F.explode(F.split(F.lower(F.concat("p_name", F.lit(" the and la le der"))), " ")).alias("term")).distinct()
    return features.top_terms(texts(spark, sf), "doc_id", "text", stop_words=stop).withColumn("weight", r6("weight"))


_TOKENS = r"""t AS (SELECT doc_id, list_filter(string_split(translate(lower(text), '!"#$%&()*+,-./:;<=>?@[\]^_`{|}~' || chr(9) || chr(10) || '¡¿',
    repeat(' ', 35)), ' '), lambda x: x <> '') AS tokens FROM documents),
    u AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM t),
    vocabulary AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS index, count(*) AS count, count(DISTINCT doc_id) AS documents FROM u GROUP BY 1)"""


@query(f"WITH {_TOKENS} SELECT * FROM vocabulary")
def fit_vocabulary(spark, sf):
    return features.fit_vocabulary(texts(spark, sf), "text").table


@query(f"""WITH {_TOKENS}, m AS (SELECT max(len(tokens)) AS maxlen FROM t),
           s AS (SELECT doc_id, string_agg(CAST(index AS VARCHAR), ',' ORDER BY place) AS seq, count(*) AS n FROM u JOIN vocabulary USING (token) GROUP BY 1)
           SELECT t.doc_id, CAST(maxlen - coalesce(n, 0) AS BIGINT) AS zeros, coalesce(seq, '') AS seq FROM t CROSS JOIN m LEFT JOIN s USING (doc_id)""")
def to_sequences(spark, sf):
    documents = texts(spark, sf)
    sequences = features.to_sequences(documents, "doc_id", "text", features.fit_vocabulary(documents, "text"))
    used = F.array_remove("tokens", 0)
    return sequences.select("doc_id", (F.size("tokens") - F.size(used)).cast("long").alias("zeros"), F.array_join(used, ",").alias("seq"))


def _word_vectors(spark, sf):
    """Names of parts as words, with the vector of the embedding whose id is the part's first key."""
    names = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("token"), "p_partkey").groupBy("token").agg(F.min("p_partkey").alias("vec_id"))
    return names.join(table(spark, sf, "embeddings"), "vec_id").select("token", F.col("embedding").alias("vector"))


_VECTORS = """n AS (SELECT token, min(p_partkey) AS vec_id FROM (SELECT unnest(string_split(p_name, ' ')) AS token, p_partkey FROM part) GROUP BY 1),
    vectors AS (SELECT token, embedding AS vector FROM n JOIN embeddings USING (vec_id))"""
_PARTS = """t AS (SELECT p_partkey AS doc_id, string_split(lower(p_name || ' ' || p_type), ' ') AS tokens FROM part),
    u AS (SELECT doc_id, unnest(tokens) AS token FROM t),
    vocabulary AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS index FROM u GROUP BY 1)"""


def _components(df, vector, *keys):
    return df.select(*keys, F.posexplode(vector).alias("component", "value")).select(*keys, (F.col("component") + 1).cast("long").alias("component"), r6("value").alias("value"))


@query(f"""WITH {_PARTS}, {_VECTORS} SELECT index, token, i AS component, round(coalesce(vector[i], 0)::DOUBLE, 6) AS value
           FROM vocabulary LEFT JOIN vectors USING (token), range(1, 65) AS r(i)""")
def embedding_lookup(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    out = features.embedding_lookup(features.fit_vocabulary(parts, "text").table, _word_vectors(spark, sf), 64)
    return _components(out, "vector", "index", "token")


@query(f"""WITH {_PARTS}, {_VECTORS}, e AS (SELECT token, list_transform(vector, lambda x: x::DOUBLE) AS v FROM vectors),
           k AS (SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM u JOIN e USING (token)),
           l AS (SELECT doc_id, unnest(v) AS x, unnest(range(1, 65)) AS component FROM k),
           m AS (SELECT doc_id, component, avg(x) AS x FROM l GROUP BY ALL)
           SELECT t.doc_id, r.component, round(coalesce(x, 0), 6) AS value
           FROM t CROSS JOIN range(1, 65) AS r(component) LEFT JOIN m ON m.doc_id = t.doc_id AND m.component = r.component""")
def sentence_vectors(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    out = features.sentence_vectors(parts, "doc_id", "text", _word_vectors(spark, sf), 64)
    return _components(out, "features", "doc_id")


@query("""SELECT l_suppkey, round(sum(l_discount * (l_returnflag <> 'N')::INT) / greatest(sum((l_returnflag <> 'N')::INT), 1e-9), 6) AS x1,
                 round(sum(l_quantity * (l_returnflag <> 'N')::INT) / greatest(sum((l_returnflag <> 'N')::INT), 1e-9), 6) AS x2 FROM lineitem GROUP BY 1""")
def masked_mean_pool(spark, sf):
    tokens = table(spark, sf, "lineitem").select(
        "l_suppkey", (F.col("l_returnflag") != "N").cast("int").alias("mask"), F.array("l_discount", "l_quantity").alias("vector"))
    out = features.masked_mean_pool(tokens, "l_suppkey", "mask", "vector")
    return out.select("l_suppkey", r6(F.get("features", F.lit(0))).alias("x1"), r6(F.get("features", F.lit(1))).alias("x2"))


@query("""SELECT p_partkey, 'size-inches' AS feature, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price-retail', p_retailprice FROM part""")
def linguistic_features(spark, sf):
    wide = table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_size").alias("size-inches"), F.col("p_retailprice").alias("price-retail"))
    taken, names = features.linguistic_features(wide, "p_partkey")
    known = F.array(*[F.lit(n) for n in names])
    return taken.select("p_partkey", F.posexplode("features").alias("i", "value")).select("p_partkey", F.get(known, F.col("i")).alias("feature"), "value")


_LANGUAGE = f"""WITH d AS (SELECT doc_id, lang, string_split(regexp_replace(lower(text), '\\s\\s+', ' ', 'g'), '') AS c FROM documents),
  g AS (SELECT doc_id, lang, unnest(c) AS term FROM d
        UNION ALL SELECT doc_id, lang, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) FROM d
        UNION ALL SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) FROM d),
  t AS (SELECT doc_id, lang, term, count(*) AS tf FROM g GROUP BY ALL),
  c AS (SELECT lang, term, sum(tf) AS n FROM t WHERE lang IS NOT NULL GROUP BY ALL),
  totals AS (SELECT lang, sum(n) AS n FROM c GROUP BY 1),
  logs AS (SELECT v.term, totals.lang, ln((coalesce(c.n, 0) + 1) / (totals.n + (SELECT count(*) FROM c))) AS l
           FROM (SELECT DISTINCT term FROM c) v CROSS JOIN totals LEFT JOIN c ON c.term = v.term AND c.lang = totals.lang),
  sums AS (SELECT doc_id, logs.lang AS language, sum(tf * l) AS s FROM t JOIN logs USING (term) GROUP BY ALL),
  best AS (SELECT doc_id, arg_max(language, s) AS language, max(s) AS top FROM sums GROUP BY 1),
  sure AS (SELECT doc_id, best.language, 1 / sum(exp(s - top)) AS confidence FROM sums JOIN best USING (doc_id) GROUP BY 1, 2)
  SELECT doc_id, documents.lang, CASE WHEN confidence > {lx.LANGUAGE_THRESHOLD} THEN sure.language END AS language, round(confidence, 6) AS confidence
  FROM documents LEFT JOIN sure USING (doc_id)"""


@query(_LANGUAGE)
def detect_language(spark, sf):
    documents = texts(spark, sf)
    profiles = features.fit_language_profiles(documents, "text", "lang")
    return features.detect_language(documents, "doc_id", "text", profiles, lx.LANGUAGE_THRESHOLD).select("doc_id", "lang", "language", r6("confidence").alias("confidence"))
