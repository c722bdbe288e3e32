"""SimHash near-duplicates by an inverted index over byte positions.

A fingerprint has eight bytes. Two fingerprints that differ in at most three bits agree in at least five byte
positions, so in one half of the bytes they agree in three of four. The index therefore holds each distinct fingerprint under the three-byte
parts of either half; two postings of an entry tally the positions they share, go on if
these reach the guaranteed five, and are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import extended, small_batches, stored, text_bytes
from penprint.llm.graph import components

SHINGLE = 3
SEED = 42
BYTES = 8
HALVES = (range(0, 4), range(4, 8))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, as a signed number; 0 if it has no words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, SEED) for p in parts], ">u8")
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start:start + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def with_fingerprint(docs: DataFrame, carry: Sequence[str], text: str = "text") -> DataFrame:
    """``carry`` columns and ``_fp``, the fingerprint of the whole text. A null text has no words."""
    n = len(carry)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            marks = pa.array([fingerprint(t) for t in text_bytes(batch.column(n))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + [marks], names=[*carry, "_fp"])

    schema = extended(docs.select(*carry).schema, "_fp long")
    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(compute, schema)


def _byte(mark: Column, position: int) -> Column:
    return F.shiftrightunsigned(mark, 8 * position).bitwiseAND(F.lit(255))


def link_pairs(nodes: DataFrame, bits: int = 3) -> DataFrame:
    """Pairs (u, v) of ``node`` whose fingerprints ``_fp`` differ in at most ``bits`` (3 or fewer) bits.

    ``nodes`` holds distinct fingerprints. Entries of the index are dealt by their three bytes; a pair is
    given by the first entry that both share. A frequent entry is a skewed join key, which Spark splits.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees pairs of at most 3 differing bits")
    parts = [p for half in HALVES for p in combinations(half, 3)]
    keys = [
        F.struct(F.lit(i).alias("part"), sum((F.shiftleft(_byte(F.col("_fp"), p), 8 * k) for k, p in enumerate(part)), F.lit(0).cast("long")).alias("value"))
        for i, part in enumerate(parts)
    ]
    postings = nodes.select("node", "_fp", F.explode(F.array(*keys)).alias("key")).select("node", "_fp", "key.part", "key.value")
    left = postings.select(F.col("node").alias("u"), F.col("_fp").alias("_a"), "part", "value")
    right = postings.select(F.col("node").alias("v"), F.col("_fp").alias("_b"), "part", "value")
    differ = F.col("_a").bitwiseXOR(F.col("_b"))
    same = [(_byte(differ, p) == 0).cast("int") for p in range(BYTES)]
    tally = sum(same, F.lit(0))
    first = F.lit(len(parts))
    for i, part in reversed(list(enumerate(parts))):
        first = F.when(sum((same[p] for p in part), F.lit(0)) == 3, i).otherwise(first)
    matched = (
        (left["part"] == right["part"]) & (left["value"] == right["value"]) & (F.col("u") < F.col("v"))
        & (tally >= BYTES - bits) & (F.bit_count(differ) <= bits) & (first == left["part"])
    )
    return left.join(right, matched).select("u", "v")


def components_of(marks: DataFrame, bits: int = 3) -> DataFrame:
    """``_fp``, ``_group`` and ``component_id`` of every distinct fingerprint of ``marks`` (doc_id, _fp).

    A group is known by one of its fingerprints; components may have the same smallest id where ids repeat.
    """
    nodes = stored(marks.groupBy("_fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("_fp")), "nodes")
    reached = components(link_pairs(nodes, bits))
    grouped = nodes.join(reached, "node", "left").select("_fp", "least", F.coalesce("component", "node").alias("_group"))
    return grouped.join(grouped.groupBy("_group").agg(F.min("least").alias("component_id")), "_group").select("_fp", "_group", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long) and ``component_id`` of every row of ``docs``.

    Rows are connected through chains of fingerprints that differ in at most ``bits`` bits; the component is named
    by its smallest id. A text without words has the fingerprint zero and is linked like any other. Copies meet in one distinct
    fingerprint before anything is paired. A null id is kept and names a component only if all its ids are null.
    Repeated rows stay. Other columns are not carried.
    """
    marks = stored(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"]), "marks")
    return marks.join(components_of(marks, bits), "_fp").select("doc_id", F.col("_fp").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 3) -> DataFrame:
    """One row of each component of near-duplicates, with all columns of ``docs``: the one with the smallest id.

    Of rows that share that id, the first in the order of the stored rows stays. Null ids come last.
    The choice is made on ids alone; the documents are joined to it by the row's number.
    """
    columns = docs.columns
    rows = stored(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc")), "rows")
    keyed = rows.select("_row", F.col(f"_doc.`{doc_id}`").alias("doc_id"), F.col(f"_doc.`{text}`").alias("text"))
    marked = stored(with_fingerprint(keyed, ["_row", "doc_id"]), "marked")
    grouped = marked.join(components_of(marked.select("doc_id", "_fp"), bits), "_fp")
    first = grouped.groupBy("_group").agg(F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_row"))
    return rows.join(first, "_row", "left_semi").select("_doc.*")


def hex_digits(mark: Column) -> Column:
    return F.lower(F.lpad(F.hex(mark), 16, "0"))
