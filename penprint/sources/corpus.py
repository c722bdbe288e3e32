"""Readers, writers and exports for corpora, helper tables and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from penprint.functions.order import characters_before, order_key
from penprint.session import durable
from penprint.spec import SPLITS


def read_corpus(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """Scan a corpus; CSV input has a header, quoted fields and may hold line ends."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        return reader.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return reader.format(fmt).load(path)


def read_or_compute(spark: SparkSession, path: str, compute, refresh: bool = False, fmt: str = "parquet", schema=None) -> DataFrame:
    """Read a stored table, computing and storing it when it is missing or ``refresh`` is set."""
    # A table whose writing was broken off has no success mark and is computed again.
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    stored = done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    if refresh or not stored:
        write_corpus(compute(), path, fmt=fmt)
    return read_corpus(spark, path, schema=schema, fmt=fmt)


def date_range(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Keep the rows from the start of day ``start`` to the end of day ``end``.

    The bounds stand alone on one side, so they reach the scan.
    """
    kind = df.schema[ts].dataType.simpleString()
    after = F.date_add(F.to_date(F.lit(end)), 1)
    return df.where((F.col(ts) >= F.to_date(F.lit(start)).cast(kind)) & (F.col(ts) < after.cast(kind)))


def source_fields(df: DataFrame, fields: Sequence[str], id_column: str | None = None, ids: Sequence | None = None) -> DataFrame:
    """Keep the named columns of the corpora whose id is listed."""
    if id_column is not None and ids is not None:
        df = df.where(F.col(id_column).isin(list(ids)))
    return df.select(*fields)


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Store a corpus; CSV output quotes every field."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True, quoteAll=True, escape='"')
    else:
        writer.format(fmt).save(path)


def read_helper(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read a helper table (author traits, topics, account map).

    No broadcast is forced: Spark broadcasts it when its measured size allows.
    """
    return spark.read.schema(schema).csv(path, header=True)


def round_features(features: Column, digits: int) -> Column:
    return F.transform(features, lambda v: F.round(v, digits))


def write_features(df: DataFrame, path: str, features: str = "features", digits: int = 5, mode: str = "overwrite") -> None:
    """Store a feature table (id and an array of doubles) rounded to ``digits``.

    ``mode='ignore'`` keeps a table that is already there.
    """
    df.withColumn(features, round_features(F.col(features), digits)).write.mode(mode).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


PART_CHARACTERS = 2**26


def author_documents(
    df: DataFrame, split: str, label: str, doc_id: str, text: str, seed: int = 0, part_characters: int = PART_CHARACTERS
) -> DataFrame:
    """One row per author and part: split, label, ``part``, ids and texts in a seeded order.

    Characters are counted along the order, ids as ten each, and a document belongs to the part in which it starts, by the same rule
    at every size (``merge_by_author``). An author of a third of the documents is cut into parts by many tasks.
    """
    length = F.char_length(F.coalesce(F.col(text), F.lit(""))) + 10
    rows = df.where(F.col(split).isin(*SPLITS)).select(
        split, label, order_key(seed, doc_id).alias("_key"), F.col(doc_id).alias("id"), F.col(text).alias("text"), length.cast("long").alias("_length"))
    return (
        characters_before(rows, [split, label], ["_key", "id"], "_length")
        .withColumn("part", F.floor(F.col("_before") / part_characters).cast("int"))
        .groupBy(split, label, "part")
        .agg(F.array_sort(F.collect_list(F.struct("_key", "id", "text"))).alias("_docs"))
        .select(split, label, "part", F.col("_docs.id").alias("ids"), F.col("_docs.text").alias("texts"))
    )


def export_author_documents(
    df: DataFrame, path: str, task: str, split: str, label: str, doc_id: str, text: str,
    seed: int = 0, part_characters: int = PART_CHARACTERS,
) -> None:
    """Write ``<author id=…>`` elements with ``<document>`` children, ids and texts apart,
    one folder per task and split. The elements are put together once and stored for the six folders."""
    elements = durable(author_documents(df, split, label, doc_id, text, seed, part_characters))
    for name in SPLITS:
        rows = elements.where(F.col(split) == name)
        for content, column in (("ids", F.col("ids").cast("array<string>")), ("texts", F.col("texts"))):
            (
                rows.select(F.col(label).alias("_id"), F.col("part").alias("_part"), column.alias("document"))
                .write.mode("overwrite").format("xml").option("rowTag", "author").option("rootTag", "authors")
                .save(f"{path}/task={task}/split={name}/{content}")
            )


def export_truth(df: DataFrame, by: str, doc_id: str, traits: Sequence[str]) -> DataFrame:
    """First non-null value of each trait per label, first meaning lowest document id."""
    return df.groupBy(by).agg(
        *[F.min_by(t, F.when(F.col(t).isNotNull(), F.col(doc_id))).alias(t) for t in traits]
    )


def export_counts(tables: dict[str, DataFrame], path: str) -> None:
    """Write each statistics table as CSV under its name."""
    for name, table in tables.items():
        table.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def prediction_table(documents: DataFrame, predictions: DataFrame, doc_id: str, text: str, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """Text, predicted and actual label per document, joined by document id."""
    return documents.select(doc_id, text).join(predictions.select(doc_id, predicted, actual), doc_id)


def probability_table(df: DataFrame, probabilities: Column, labels: Sequence[str], feature_set: str, doc_id: str, actual: str) -> DataFrame:
    """Feature-set name, one probability column per label and the actual label.

    ``probabilities`` is an array; with two labels it may hold only the first.
    """
    at = [F.get(probabilities, F.lit(i)) for i in range(len(labels))]
    if len(labels) == 2:
        at[1] = F.coalesce(at[1], 1 - at[0])
    return df.select(
        F.lit(feature_set).alias("features"), doc_id,
        *[p.alias(name) for p, name in zip(at, labels)], F.col(actual).alias("label"),
    )
