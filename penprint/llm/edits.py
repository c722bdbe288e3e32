"""How far fingerprints follow an edit: every text against itself with its end replaced, and against the text after it.

Texts are taken in the falling order of their ids. Cut points of the ids, a few for each partition, deal them into ranges; the first
row of a range goes along with the range before as well, so that each task streams over its range and looks one row ahead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import partitions, small_batches, text_bytes
from penprint.llm.digests import Rarity, digests_of, likeness, spelled

BLOCK = 1 << 20  # bytes of texts compared in one sweep
RANGES = 4  # per partition, so that ranges dealt by a hash fill the partitions evenly
COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def range_of(key: Column, bounds: Sequence[int]) -> Column:
    """How many of the falling ``bounds`` are larger, by binary search; a null key comes after all."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    there = F.lit(list(bounds))
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.get(there, low + step - 1) > key, low + step).otherwise(low))
    return F.when(key.isNull(), len(bounds)).otherwise(found)


def ranges_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``range``, ``ahead``, ``doc_id`` and ``text``: rows of a range stand together in one partition, in falling order of ids.

    Null ids come last; rows of one id are in the order of a hash of their texts. Behind each range, with ``ahead`` 1, is the first row of the
    next one, of the first one for the last. (Rows may follow that share its id.)
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    parts = partitions(docs.sparkSession)
    shares = [i / (RANGES * parts) for i in range(1, RANGES * parts)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 20 * RANGES * parts)).first()[0] or []), reverse=True)
    ranged = rows.withColumn("range", range_of(F.col("doc_id"), bounds))
    firsts = {r["range"]: r["first"] for r in ranged.groupBy("range").agg(F.max("doc_id").alias("first")).collect()}
    held = sorted(firsts)
    before = {r: held[i - 1] for i, r in enumerate(held)}
    first = F.get(F.lit([firsts.get(r) for r in range(len(bounds) + 1)]).cast("array<bigint>"), F.col("range"))
    previous = F.get(F.lit([before.get(r) for r in range(len(bounds) + 1)]).cast("array<int>"), F.col("range"))
    also = F.when(F.col("doc_id").eqNullSafe(first), F.array(F.struct(F.col("range"), F.lit(0).alias("ahead")), F.struct(previous.alias("range"), F.lit(1).alias("ahead"))))
    places = F.coalesce(also, F.array(F.struct(F.col("range"), F.lit(0).alias("ahead"))))
    dealt = ranged.select(F.explode(places).alias("at"), "doc_id", "text").select("at.range", "at.ahead", "doc_id", "text")
    return dealt.repartition(parts, "range").sortWithinPartitions("range", "ahead", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


def edited(text: str, following: str) -> tuple[str, int]:
    """``text`` with the last third of its characters replaced by as many of the start of another, and how many stay."""
    replaced = len(text) // 3
    return text[:len(text) - replaced] + following[:replaced], len(text) - replaced


def compare_edits(docs: DataFrame, rarity: Rarity, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: fingerprints of its text and its edited text, and likeness to the latter and to the next text.

    The edited text has the last third of the characters (code points) replaced by the first as many of the next row, all of
    it if that is shorter; next in the falling order of ids (whole numbers), the first after the last. A null text is
    empty, and equal to its edit. A single row follows itself. Other columns are not carried; an empty table gives no rows.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int | None, bytes]] = []
        size = 0
        current: int | None = None
        closed = False

        def block(following: bytes) -> pa.RecordBatch:
            raw = [data for _, data in waiting] + [following]
            texts = [data.decode() for data in raw]
            changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
            chains = digests_of(
                raw + [new.encode() for new, _ in changed], rarity,
                [None] * len(raw) + [(i, len(texts[i][:stays].encode())) for i, (_, stays) in enumerate(changed)])
            own, new = chains[:len(raw)], chains[len(raw):]
            columns = [
                pa.array([name for name, _ in waiting], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(c.encode()).hexdigest() for c, _ in changed]), pa.array([spelled(c) for c in own[:-1]], pa.string()),
                pa.array([spelled(c) for c in new], pa.string()), pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64())]
            return pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in small_batches(batches):
            for where, ahead, name, data in zip(*(batch.column(i).to_pylist() for i in range(3)), text_bytes(batch.column(3))):
                if where != current:
                    current, closed = where, False
                if closed:
                    continue
                if waiting and (size > BLOCK or ahead):
                    yield block(data)
                    waiting, size = [], 0
                if ahead:
                    closed = True
                else:
                    waiting.append((name, data))
                    size += len(data)

    return ranges_with_next(docs, doc_id, text).mapInArrow(compare, COMPARED)
