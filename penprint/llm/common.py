"""What the operators share: stage tables in the shared folder, and texts of Arrow columns as bytes."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one machine alone may use a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="penprint-stages-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """``stored``, dealt by ``key``: later joins and groupings by it do not shuffle these rows again.

    The number of buckets is that of shuffle partitions, which grows with the cluster's inputs. The catalog's entry is needed
    only to plan the table and goes at once.
    """
    spark = df.sparkSession
    buckets = partitions(spark)
    path = new_path(spark, label)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    (df.repartition(buckets, key).write.option("path", path).option("compression", "zstd")
     .format("parquet").bucketBy(buckets, key).saveAsTable(name))
    out = spark.table(name)
    out.schema  # resolved; the files stay when the catalog forgets them
    spark.sql(f"DROP TABLE `{name}`")
    return out


def extended(schema: StructType, columns: str) -> StructType:
    """``schema`` and more columns, in SQL."""
    return StructType([*schema.fields, *StructType.fromDDL(columns).fields])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: Column | str) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))


def text_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The texts (or binaries) of an Arrow column as bytes, one at a time."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from text_bytes(chunk)
        return
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    for value in column:
        yield value.as_py()


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes, so that long texts do not pile up in a task."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
