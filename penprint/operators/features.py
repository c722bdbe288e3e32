"""Features of texts: weighted n-grams, vocabularies and sequences, pooled vectors, language."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from penprint.functions import grams
from penprint.functions import lexicon as lx
from penprint.functions.order import first_per_group, global_rank
from penprint.functions.tokens import characters, term_counts, vocabulary_tokens, words
from penprint.operators.reduction import fit_sparse_svd
from penprint.session import stored


# --- Weighted n-grams ------------------------------------------------------------
@dataclass(frozen=True)
class GramWeights:
    """A fitted n-gram vocabulary: columns ``term``, ``index``, ``total``, ``df``, ``idf``, at most ``max_features`` rows."""

    table: DataFrame
    kind: str
    n: tuple[int, int]
    size: int
    sublinear: bool = True

    def weights(self, df: DataFrame, doc_id: str, text: str) -> DataFrame:
        """Weight of each vocabulary term in each document, rows of unit length: id, ``index``, ``weight``.

        Terms outside the vocabulary are dropped before anything is shuffled.
        """
        tf = F.col("tf").cast("double")
        raw = (1 + F.ln(tf) if self.sublinear else tf) * F.col("idf")
        # The vocabulary has at most ``size`` terms: only these are counted.
        held = self.table.select("term", "index").orderBy("index").collect()
        counts = gram_counts(df, doc_id, text, self.kind, [r["term"] for r in held], [r["index"] for r in held])
        found = counts.join(F.broadcast(self.table), "index").select(doc_id, "index", raw.alias("_raw"))
        cells = found.groupBy(doc_id).agg(
            F.sqrt(F.sum(F.col("_raw") * F.col("_raw"))).alias("_norm"), F.collect_list(F.struct("index", "_raw")).alias("_cells")
        )
        spread = cells.select(doc_id, "_norm", F.explode("_cells").alias("_c")).select(
            doc_id, F.col("_c.index").alias("index"), (F.col("_c._raw") / F.col("_norm")).alias("weight")
        )
        return spread.join(F.broadcast(self.table.select("index", "term")), "index").select(doc_id, "index", "term", "weight")

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> GramWeights:
        return GramWeights(spark.read.parquet(path), self.kind, self.n, self.size, self.sublinear)


def _tokens(df: DataFrame, keys: Sequence[str], text: str, kind: str) -> DataFrame:
    """The keys and the tokens of each row: an array of words, or a text of which every character is one."""
    return df.select(*keys, (words if kind == "word" else characters)(F.coalesce(F.col(text), F.lit(""))).alias("_tokens"))


def gram_counts(df: DataFrame, doc_id: str, text: str, kind: str, terms: Sequence[str], index: Sequence[int]) -> DataFrame:
    """Which of a few ``terms`` each row has, by their ``index``, and how often: id, ``index``, ``tf``."""
    rows = _tokens(df.withColumnRenamed(doc_id, "_id"), ["_id"], text, kind)
    places = F.array(*[F.lit(i).cast("int") for i in index]) if len(index) else F.array().cast("array<int>")
    schema = StructType([rows.schema["_id"], *StructType.fromDDL("_places array<int>, _tf array<long>").fields])
    found = rows.mapInArrow(lambda batches: grams.chosen_counts(batches, kind, terms, ("_id", "_places", "_tf")), schema)
    cells = found.select(F.col("_id").alias(doc_id), F.explode(F.arrays_zip("_places", "_tf")).alias("_c"))
    return cells.select(doc_id, F.get(places, F.col("_c._places")).alias("index"), F.col("_c._tf").alias("tf"))


def _totals(df: DataFrame, text: str, kind: str, n: tuple[int, int], below: tuple[int, Sequence[str]] | None = None) -> DataFrame:
    """``term``, ``tf`` and ``df`` of all n-grams. They are added up inside the tasks first."""
    found = _tokens(df, [], text, kind).mapInArrow(lambda batches: grams.totals(batches, kind, n, below), "term string, tf long, df long")
    return found.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


PARTS = 100_000  # shortest n-grams that are sent to the tasks at most


def _fit_grams(
    df: DataFrame, text: str, kind: str, n: tuple[int, int], min_df: int, max_features: int, sublinear: bool,
    stop_words: DataFrame | None = None,
) -> GramWeights:
    """The ``max_features`` most used n-grams.

    No n-gram is used more often than a shorter one inside it. The shortest are counted first: where ``max_features`` of them are used at least so often,
    a longer one can be among the most used only if all its shortest parts are used as often, and only these are counted.
    """
    def eligible(counts: DataFrame) -> DataFrame:
        kept = counts if stop_words is None else counts.join(stop_words.select("term"), "term", "left_anti")
        return kept.where(F.col("df") >= min_df)

    documents = df.agg(F.count("*")).scalar()
    counts = stored(_totals(df, text, kind, (n[0], n[0])))
    if n[1] > n[0]:
        first = eligible(counts).select("tf").orderBy(F.desc("tf")).limit(max_features).collect()
        least = first[-1]["tf"] if len(first) == max_features and first else 0
        parts = [r["term"] for r in counts.where(F.col("tf") >= least).select("term").limit(PARTS + 1).collect()] if least else []
        below = (n[0], parts) if least and len(parts) <= PARTS else None
        counts = counts.unionByName(_totals(df, text, kind, (n[0] + 1, n[1]), below))
    kept = eligible(counts).orderBy(F.desc("tf"), "term").limit(max_features)
    # A window without partitions, over at most max_features rows.
    index = F.row_number().over(Window.orderBy("term")) - 1
    idf = F.ln((1 + documents) / (1 + F.col("df"))) + 1
    table = _held(kept.select("term", index.alias("index"), F.col("tf").alias("total"), "df", idf.alias("idf")))
    return GramWeights(table, kind, n, max_features, sublinear)


def _held(fitted: DataFrame) -> DataFrame:
    """A fitted table whose size is bounded by a parameter, computed once and kept as literal rows."""
    return fitted.sparkSession.createDataFrame(fitted.collect(), fitted.schema)


def word_tfidf(
    df: DataFrame, text: str, n: tuple[int, int] = (1, 3), min_df: int = 2, max_features: int = 100, sublinear: bool = True,
    stop_words: DataFrame | None = None,
) -> GramWeights:
    """Fit word n-grams: the most used terms found in at least ``min_df`` documents, ties by term."""
    return _fit_grams(df, text, "word", n, min_df, max_features, sublinear, stop_words)


def char_tfidf(df: DataFrame, text: str, n: tuple[int, int] = (3, 5), min_df: int = 2, max_features: int = 100, sublinear: bool = True) -> GramWeights:
    """Fit character n-grams in the same way."""
    return _fit_grams(df, text, "char", n, min_df, max_features, sublinear)


def ngram_cells(df: DataFrame, doc_id: str, text: str, parts: Sequence[GramWeights]) -> tuple[DataFrame, int]:
    """Sparse rows, the parts side by side: ``doc_id``, ``columns`` and ``weights`` (arrays, empty if no term is found), and how many columns there are."""
    offset, stacked = 0, None
    for part in parts:
        rows = part.weights(df, doc_id, text).select(doc_id, (F.col("index") + offset).alias("index"), "weight")
        stacked = rows if stacked is None else stacked.unionByName(rows)
        offset += part.size
    cells = stacked.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("_cells"))
    return df.select(doc_id).join(cells, doc_id, "left").select(
        doc_id, F.coalesce(F.col("_cells.index").cast("array<int>"), F.array().cast("array<int>")).alias("columns"),
        F.coalesce("_cells.weight", F.array().cast("array<double>")).alias("weights")), offset


def ngram_vectors(df: DataFrame, doc_id: str, text: str, parts: Sequence[GramWeights], name: str = "ngrams") -> DataFrame:
    """One vector per document, the parts side by side; no term found gives a zero vector."""
    cells, width = ngram_cells(df, doc_id, text, parts)

    @F.pandas_udf("array<double>")
    def spread(index: pd.Series, weight: pd.Series) -> pd.Series:
        def one(i, w):
            row = np.zeros(width)
            if i is not None:
                row[np.asarray(i, dtype=int)] = w
            return row

        return pd.Series([one(i, w) for i, w in zip(index, weight)])

    dense = cells.select(doc_id, spread("columns", "weights").alias("_dense"))
    return dense.select(doc_id, array_to_vector("_dense").alias(name))


@dataclass(frozen=True)
class Reduction:
    """Right singular vectors of the training matrix: one row per input column."""

    components: list[list[float]]

    def transform(self, df: DataFrame, vectors: str, name: str = "features") -> DataFrame:
        matrix = np.asarray(self.components)

        @F.pandas_udf("array<double>")
        def project(rows: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(rows.to_list()) @ matrix)) if len(rows) else pd.Series([], dtype=object)

        return df.withColumn(name, project(vector_to_array(F.col(vectors))))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(list(enumerate(self.components)), "index int, row array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Reduction:
        return Reduction([r["row"] for r in spark.read.parquet(path).orderBy("index").collect()])


def fit_svd(train: DataFrame, vectors: str, k: int = 100) -> Reduction:
    """Truncated singular value decomposition; the columns of the result are the ``k`` strongest directions.

    One pass: every task adds up the Gram matrix of its rows, and the sums of the
    small square matrices are decomposed. The sign of a direction is arbitrary.
    """

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                rows = np.stack(batch["row"].to_list())
                total = rows.T @ rows + (0 if total is None else total)
        if total is not None:
            yield pd.DataFrame({"place": range(len(total)), "sums": list(total)})

    partial = train.select(vector_to_array(F.col(vectors)).alias("row")).mapInPandas(gram, "place int, sums array<double>")
    rows = partial.groupBy("place").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).orderBy("place").collect()
    values, directions = np.linalg.eigh(np.stack([r["sums"].toArray() for r in rows]))
    return Reduction(directions[:, np.argsort(-values)[:k]].tolist())


def reduce_svd(train: DataFrame, df: DataFrame, doc_id: str, text: str, k: int = 100, max_features: int = 100) -> DataFrame:
    """Word and character n-grams fitted on ``train``, both reduced to ``k`` numbers for every row of ``df``. Rows stay sparse throughout."""
    parts = [word_tfidf(train, text, max_features=max_features), char_tfidf(train, text, max_features=max_features)]
    cells, width = ngram_cells(train, doc_id, text, parts)
    reduction = fit_sparse_svd(stored(cells), width, k)
    return reduction.transform(ngram_cells(df, doc_id, text, parts)[0], doc_id)


def top_terms(df: DataFrame, doc_id: str, text: str, k: int = 100, stop_words: DataFrame | None = None) -> DataFrame:
    """Words by their summed weight over the documents: ``term``, ``weight``."""
    fitted = word_tfidf(df, text, n=(1, 1), min_df=1, max_features=k, sublinear=False, stop_words=stop_words)
    return fitted.weights(df, doc_id, text).groupBy("term").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "term").limit(k)


# --- Vocabulary and sequences ------------------------------------------------------
OUT_OF_VOCABULARY = 1


@dataclass(frozen=True)
class Vocabulary:
    """Columns ``token``, ``index`` (from 2, by falling count), ``count``, ``documents``."""

    table: DataFrame
    documents: int
    maxlen: int
    num_words: int | None = None

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/tokens")
        spark = self.table.sparkSession
        spark.createDataFrame([(self.documents, self.maxlen, self.num_words)], "documents long, maxlen int, num_words int").write.mode(
            "overwrite").parquet(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Vocabulary:
        facts = spark.read.parquet(f"{path}/facts").first()
        return Vocabulary(spark.read.parquet(f"{path}/tokens"), facts["documents"], facts["maxlen"], facts["num_words"])


def fit_vocabulary(df: DataFrame, text: str, num_words: int | None = None) -> Vocabulary:
    """Index tokens by falling count, ties by token; also document counts and the longest sequence."""
    rows = df.select(vocabulary_tokens(F.coalesce(F.col(text), F.lit(""))).alias("_grams"))
    found = rows.mapInArrow(lambda batches: grams.totals(batches, "word", (1, 1)), "term string, tf long, df long")
    counts = found.groupBy(F.col("term").alias("token")).agg(F.sum("tf").alias("count"), F.sum("df").alias("documents"))
    ranked = global_rank(counts, [F.desc("count"), F.col("token")], "_rank")
    facts = rows.agg(F.count("*"), F.max(F.size("_grams"))).first()
    table = ranked.select("token", (F.col("_rank") + OUT_OF_VOCABULARY).alias("index"), "count", "documents")
    return Vocabulary(table, facts[0], facts[1] or 0, num_words)


HELD_WORDS = 200_000  # most used words that are sent to every task


def to_sequences(df: DataFrame, doc_id: str, text: str, vocabulary: Vocabulary, name: str = "tokens") -> DataFrame:
    """Token indexes of each document, zeros in front up to the training length, longer ones cut in front.

    Only the tokens that will be kept are looked up, the ``HELD_WORDS`` most used ones of the vocabulary inside the tasks. Occurrences of the others are
    joined by word and come back to their document; where there are none, nothing is joined. A place and its index are one long, the place in the upper half.
    """
    tokens = vocabulary_tokens(F.coalesce(F.col(text), F.lit("")))
    maxlen = vocabulary.maxlen
    tail = df.select(F.col(doc_id).alias("_id"), tokens.alias("_all")).select(
        "_id", F.when(F.size("_all") > maxlen, F.slice("_all", -maxlen, maxlen)).otherwise(F.col("_all")).alias("_kept")
    )
    known = vocabulary.table.select("token", "index")
    if vocabulary.num_words is not None:
        known = known.where(F.col("index") < vocabulary.num_words)
    used = F.col("index") <= HELD_WORDS + OUT_OF_VOCABULARY
    held = known.where(used).toArrow()
    shared = df.sparkSession.sparkContext.broadcast((held["token"].combine_chunks(), held["index"].to_numpy().astype(np.int64)))
    others = known.where(~used)
    whole = others.isEmpty()
    longs = ArrayType(LongType(), False)
    schema = StructType([tail.schema["_id"], StructField("_places", longs, False), *StructType.fromDDL("_others array<struct<at int, token string>>").fields])
    placed = tail.mapInArrow(lambda batches: grams.placed(batches, *shared.value, OUT_OF_VOCABULARY if whole else None, ("_id", "_places", "_others")), schema)
    if not whole:
        placed = stored(placed)
        rare = placed.select("_id", F.explode("_others").alias("_o")).select("_id", "_o.at", "_o.token").join(others, "token", "left")
        found = F.shiftleft(F.col("at").cast("long"), 32) + F.coalesce("index", F.lit(OUT_OF_VOCABULARY)).cast("long")
        placed = placed.select("_id", "_places").unionAll(rare.select("_id", F.array(F.coalesce(found, F.lit(0).cast("long"))).alias("_places")))
    sequences = placed.groupBy(F.col("_id").alias(doc_id)).agg(F.sort_array(F.flatten(F.collect_list("_places"))).alias("_found"))
    padding = F.array_repeat(F.lit(0), F.lit(maxlen) - F.size("_found"))
    return sequences.select(doc_id, F.concat(padding, F.transform("_found", lambda v: v.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))).alias(name))


def embedding_lookup(vocabulary: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """First ``dim`` components of each token's vector, zeros for unknown tokens: ``index``, ``token``, ``vector``.

    Index 0 stays reserved and has no row.
    """
    zero = F.array_repeat(F.lit(0.0), dim)
    vector = F.slice(F.col("vector").cast("array<double>"), 1, dim)
    return vocabulary.select("token", "index").join(embeddings, "token", "left").select("index", "token", F.coalesce(vector, zero).alias("vector"))


def sentence_vectors(df: DataFrame, doc_id: str, text: str, embeddings: DataFrame, dim: int, name: str = "features") -> DataFrame:
    """Mean of the unit word vectors of each document; zeros if no word has a vector.

    Words are counted inside their row, so a word repeated in a text is looked up once.
    """
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    unit = (
        embeddings.select("token", F.slice(F.col("vector").cast("array<double>"), 1, dim).alias("_v")).withColumn("_norm", norm)
        .select("token", F.transform("_v", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(0.0)).alias("_unit"))
    )
    rows = df.select(doc_id, vocabulary_tokens(F.coalesce(F.col(text), F.lit(""))).alias("_grams"))
    pooled = (
        term_counts(rows, [doc_id]).join(unit, F.col("term") == F.col("token"))
        .groupBy(doc_id).agg(Summarizer.mean(array_to_vector("_unit"), F.col("tf").cast("double")).alias("_mean"))
        .select(doc_id, vector_to_array("_mean").alias("_mean"))
    )
    return df.select(doc_id).join(pooled, doc_id, "left").select(doc_id, F.coalesce("_mean", F.array_repeat(F.lit(0.0), dim)).alias(name))


def masked_mean_pool(tokens: DataFrame, doc_id: str, mask: str, vector: str, name: str = "features") -> DataFrame:
    """Sum of the unmasked token vectors over the number of unmasked tokens, per document."""
    weighted = F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.col(mask).cast("double"))
    pooled = tokens.groupBy(doc_id).agg(
        Summarizer.sum(array_to_vector(weighted)).alias("_sum"), F.greatest(F.sum(F.col(mask).cast("double")), F.lit(1e-9)).alias("_n")
    )
    return pooled.select(doc_id, F.transform(vector_to_array("_sum"), lambda x: x / F.col("_n")).alias(name))


def linguistic_features(df: DataFrame, doc_id: str, name: str = "features") -> tuple[DataFrame, list[str]]:
    """Take in a wide table of ``category-feature`` columns as one array, with the column names."""
    names = [c for c in df.columns if "-" in c and c != doc_id]
    return df.select(doc_id, F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias(name)), names


# --- Language --------------------------------------------------------------------
PROFILE_ROWS = 1_000_000  # n-grams of a broadcast block, some 100 MB


@dataclass(frozen=True)
class LanguageProfiles:
    """Smoothed log share of frequent character n-grams per language: ``term`` and an array in the order of ``languages``."""

    table: DataFrame
    languages: list[str]
    n: tuple[int, int]


def fit_language_profiles(df: DataFrame, text: str, language: str, n: tuple[int, int] = (1, 3), per_language: int | None = None) -> LanguageProfiles:
    """Count all n-grams of labelled texts; ``per_language`` keeps only the most frequent ones of each language."""
    rows = _tokens(df.where(F.col(language).isNotNull()).withColumnRenamed(language, "_language"), ["_language"], text, "char")
    kinds = StructType([rows.schema["_language"], *StructType.fromDDL("term string, tf long").fields])
    found = rows.mapInArrow(lambda batches: grams.group_totals(batches, "char", n, ("_language", "term", "tf")), kinds)
    # Read for the languages, their totals and the shares.
    counts = stored(found.groupBy(F.col("_language").alias(language), "term").agg(F.sum("tf").alias("n")))
    languages = [r[0] for r in counts.groupBy(language).agg(F.lit(1)).orderBy(language).select(language).collect()]
    shared = counts
    if per_language is not None:
        frequent = first_per_group(counts, [language], [F.desc("n"), F.col("term")], per_language, F.col("term")).select("term").distinct()
        shared = counts.join(frequent, "term", "left_semi")
    wide = shared.groupBy("term").pivot(language, languages).agg(F.sum("n"))
    totals = shared.groupBy(language).agg(F.sum("n").alias("n"), F.count("*").alias("terms")).collect()
    total = {r[language]: r["n"] for r in totals}
    size = sum(r["terms"] for r in totals)
    logs = [F.ln((F.coalesce(F.col(f"`{v}`"), F.lit(0)) + 1) / float(total[v] + size)) for v in languages]
    # As many rows as the corpus has n-grams: stored, not gathered.
    return LanguageProfiles(stored(wide.select("term", F.array(*logs).alias("logs"))), languages, n)


def detect_language(
    df: DataFrame, doc_id: str, text: str, profiles: LanguageProfiles, threshold: float = lx.LANGUAGE_THRESHOLD, name: str = "language"
) -> DataFrame:
    """Most likely language of each document, null unless its probability exceeds the threshold.

    Profiles are broadcast in blocks of about ``PROFILE_ROWS`` n-grams. What leaves a task is a sum for each document, block and language; no n-gram is shuffled.
    """
    sent = _tokens(df.withColumnRenamed(doc_id, "_id"), ["_id"], text, "char")
    schema, n = StructType([sent.schema["_id"], *StructType.fromDDL("_s array<double>").fields]), profiles.n
    blocks = 1 + profiles.table.count() // PROFILE_ROWS
    parts = []
    for i in range(blocks):
        block = profiles.table.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i).toArrow()
        if block.num_rows:
            logs = block["logs"].combine_chunks().flatten().to_numpy().reshape(block.num_rows, -1)
            shared = df.sparkSession.sparkContext.broadcast((block["term"].combine_chunks(), logs))
            parts.append(sent.mapInArrow(lambda batches, shared=shared: grams.scored(batches, "char", n, *shared.value, "_id"), schema))
    if not parts:
        return df.withColumn(name, F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    sums = reduce(DataFrame.unionAll, parts).groupBy(F.col("_id").alias(doc_id)).agg(
        *[F.sum(F.get("_s", F.lit(k))).alias(f"_{k}") for k in range(len(profiles.languages))])
    sums = sums.select(doc_id, F.array(*[f"_{k}" for k in range(len(profiles.languages))]).alias("_s"))
    top = F.array_max("_s")
    confidence = 1 / F.aggregate("_s", F.lit(0.0), lambda a, s: a + F.exp(s - top))
    names = F.array(*[F.lit(v) for v in profiles.languages])
    best: Column = F.get(names, (F.array_position("_s", top) - 1).cast("int"))
    # Small beside the texts, and read by whatever counts, keeps or reports languages: stored once.
    found = stored(sums.select(doc_id, F.when(confidence > threshold, best).alias(name), confidence.alias("confidence")))
    return df.join(found, doc_id, "left")
