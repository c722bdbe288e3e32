"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

A file holds consecutive documents in rising order of their ids::

    magic 8 bytes | width of an id, shard, number in shard (u32) | documents, of these without an id, ids (u64)
    document ids, Elias-Fano | end of each document in the id array, Elias-Fano | the array, little-endian

Boundaries take about two bits and the logarithm of the mean length each; ``TokenFile.document`` reads one
document by two selects. Shards follow each other in the order of their numbers, files in the order of theirs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penprint.llm import eliasfano
from penprint.llm.common import new_path, partitions, small_batches, stored
from penprint.llm.tokens import IDS, word_encoder

MAGIC = b"TOKENEF1"
HEAD = struct.Struct("<8sIIIQQQ")
FILE_IDS = 2 << 20  # a file is closed when it holds so many ids; documents are never split
READ = 4096  # documents of a file read into one batch of rows
MANIFEST = "shard int, number int, documents long, ids long"


def file_bytes(shard: int, number: int, doc_ids: list[int | None], ends: list[int], ids: bytes, width: int) -> bytes:
    named = [d for d in doc_ids if d is not None]  # those without an id come first
    largest = int(np.frombuffer(ids, IDS).max(initial=0))
    if largest >> 8 * width:
        raise ValueError(f"id {largest} does not fit in {width} bytes")
    head = HEAD.pack(MAGIC, width, shard, number, len(doc_ids), len(doc_ids) - len(named), len(ids) // IDS.itemsize)
    array = np.frombuffer(ids, IDS).astype(f"<u{width}").tobytes()
    return head + eliasfano.encode(np.array(named, np.int64)) + eliasfano.encode(np.array(ends, np.int64)) + array


class TokenFile:
    """A token file over bytes or a memory map."""

    def __init__(self, data: bytes | memoryview):
        magic, self.width, self.shard, self.number, self.documents, self.unnamed, self.ids = HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        view = memoryview(data)
        self.names = eliasfano.EliasFano(view[HEAD.size:])
        at = HEAD.size + self.names.size
        self.ends = eliasfano.EliasFano(view[at:])
        self.array = np.frombuffer(data, f"<u{self.width}", self.ids, at + self.ends.size)

    def name(self, i: int) -> int | None:
        return None if i < self.unnamed else self.names.select(i - self.unnamed)

    def span(self, i: int) -> tuple[int, int]:
        """Where the i-th document starts and ends in the file's array."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        start, end = self.span(i)
        return self.array[start:end]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 4, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS
) -> DataFrame:
    """Encode every whole text and ``end_id`` into files under ``path``; returns the stored manifest, one row per file.

    Documents are dealt by ranges of their id. A file is written under a name of its own and then moved to its place, so
    a task that is run again, or twice, leaves the same files. Null texts hold the end id alone; null ids come
    first; rows that share an id follow each other. An empty table gives no files.
    """
    where, _ = _open(path)
    where.create_dir(_open(path)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], IDS).tobytes()
        target, root = _open(path)
        names: list[int | None] = []
        ends: list[int] = []
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            draft, final = f"{root}/_{uuid4().hex}", f"{root}/{shard:06d}-{number:06d}.tok"
            with target.open_output_stream(draft) as out:
                out.write(file_bytes(shard, number, names, ends, b"".join(parts), width))
            target.move(draft, final)
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([ends[-1]], pa.int64())],
                names=["shard", "number", "documents", "ids"])
            names.clear(), ends.clear(), parts.clear()
            return row

        for batch in small_batches(batches):
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(value) + end
                names.append(name)
                parts.append(ids)
                ends.append((ends[-1] if ends else 0) + len(ids) // IDS.itemsize)
                if ends[-1] >= file_ids:
                    yield close()
                    number += 1
        if names:
            yield close()

    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = dealt.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return stored(dealt.mapInArrow(write, MANIFEST), "manifest")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: shard, number, doc_id, start in its file, n_tokens and the checksum of its ids.

    Ids and boundaries of each document are selected from the coded ones; a file's numbers are never unpacked as a whole.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(content.as_buffer())
                for first in range(0, file.documents, READ):
                    rows = []
                    for i in range(first, min(first + READ, file.documents)):
                        start, end = file.span(i)
                        rows.append((file.name(i), start, end - start, zlib.crc32(file.array[start:end].astype(IDS).tobytes())))
                    columns = [pa.array(column, pa.int64()) for column in zip(*rows)]
                    place = [pa.array([at] * len(rows), pa.int32()) for at in (file.shard, file.number)]
                    yield pa.RecordBatch.from_arrays([*place, *columns], names=["shard", "number", "doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path)
    return files.select("content").mapInArrow(read, "shard int, number int, doc_id long, start long, n_tokens long, ids_crc32 long")


def with_global_starts(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Shift the starts of documents by the ids of all files before theirs.

    The sums run inside a shard and over shards, of which there are as many as partitions.
    """
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.groupBy("shard").agg(F.sum("ids").alias("ids")).select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("_shards"))
    before = Window.partitionBy("shard").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("shard", "number", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("_files"))
    shifts = files.join(shards, "shard").select("shard", "number", (F.col("_files") + F.col("_shards")).alias("_shift"))
    return rows.join(shifts, ["shard", "number"]).withColumn("start", F.col("start") + F.col("_shift")).drop("_shift")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as token files and read them back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    manifest = write_token_files(docs, path, tokenizer, end_id, width, doc_id, text)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return with_global_starts(read_documents(spark, path), manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
