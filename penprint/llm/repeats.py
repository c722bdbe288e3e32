"""Removal of byte strings that repeat, by suffix arrays over content-defined buckets.

Every window of ``width`` bytes is dealt by its minimiser, the smallest hash of a short string in it: equal windows have equal
minimisers, and neighbouring windows mostly share one, so a document falls into segments of consecutive windows. A minimiser that
occurs once in the corpus cannot belong to a repeated window; the segments of the others meet in buckets. There the suffixes are sorted in two stages
(``suffixes``), and a window is repeated if its common prefix with a neighbour in the suffix array reaches the width.

Equal segments are one: a digest of the content names them, the sort sees each once, and a separate table says in which rows they
stand. What the sort finds, spans of a segment, is carried back to the rows by one join on that name.

Windows of a bucket that lie at different distances from their minimiser differ. A bucket too large for one sort is therefore taken
apart by distance and by the bytes that all windows at some distances contain, inside the task. A bucket of more than ``BUSY``
different segments is taken apart in the same way over the cluster, into pieces of ``FINE`` windows and then single windows, whose
parents are kept as rows are for segments. Either way is exact, and no task holds more than a bounded number of segments that differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import bucketed, extended, partitions, small_batches, stored, text_bytes, utf8
from penprint.llm.suffixes import common_prefixes, suffix_array

WIDTH = 200
SHORT = 32  # bytes hashed for a minimiser
CHUNK = 1 << 19  # windows looked at together in a long document
FINE = 13
BUSY = 1 << 16  # different segments of a bucket beyond which it is split over the cluster
SORTED = 1 << 19  # bytes of segments sorted together
HELD = 8 << 20  # bytes of segments a task keeps to join equal ones

BASE = 0x5851F42D4C957F2D
MIX = np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64((1 << 20) - 1)

RUNS = "key long, _row long, first int, last int, pivot int"
SEGMENTS = "key long, segment binary, content binary, pivot int, n long, owners array<{}>, firsts array<int>"
SPANS = "segment binary, spans array<struct<first: int, end: int>>"
SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Minimisers:
    """Segments of windows that share a minimiser, with tables of powers for rolling hashes."""

    def __init__(self, width: int = WIDTH, short: int = SHORT):
        self.width, self.short = width, short
        size = CHUNK + width
        self.up, self.down = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=sums[1:])
        out = (sums[self.short:] - sums[:-self.short]) * self.down[:len(data) - self.short + 1]
        out ^= out >> np.uint64(29)
        out *= MIX
        return out ^ out >> np.uint64(32)

    def segments(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays of key, first and last window, and place of the minimiser."""
        data = np.frombuffer(text, np.uint8)
        span = self.width - self.short + 1
        for start in range(0, len(data) - self.width + 1, CHUNK):
            hashes = self.hashes(data[start:start + CHUNK + self.width - 1])
            # Ties of the leading bits go to the first place, which is the same in equal windows.
            least = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
            reach = 1
            while 2 * reach <= span:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            rest = span - reach
            least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
            edges = np.flatnonzero(least[1:] != least[:-1]) + 1
            first = np.r_[0, edges]
            last = np.r_[edges, len(least)] - 1
            place = (least[first] & PLACE).astype(np.int64)
            yield hashes[place].view(np.int64), first + start, last + start, place + start


def find_runs(width: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minimisers = Minimisers(width)
        for batch in small_batches(batches):
            for row, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                if len(text) >= width:
                    for key, first, last, place in minimisers.segments(text):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key), pa.array(np.full(len(key), row)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                             pa.array((place - first).astype(np.int32))], names=["key", "_row", "first", "last", "pivot"])
    return find


class Segments:
    """Segments on their way out of a task; equal ones become one row with several owners (rows, or longer segments)."""

    def __init__(self, owner: pa.DataType):
        self.owner = owner
        self.held: dict[bytes, list] = {}
        self.size = 0

    def add(self, key: int, content: bytes, pivot: int, n: int, owner: int | bytes, first: int) -> None:
        found = self.held.get(content)
        if found is None:
            found = self.held[content] = [key, pivot, 0, [], []]
            self.size += len(content) + 250
        found[2] += n
        found[3].append(owner)
        found[4].append(first)
        self.size += 40

    def out(self) -> pa.RecordBatch:
        contents, rows = list(self.held), list(self.held.values())
        self.held, self.size = {}, 0
        names = [hashlib.blake2b(c, digest_size=16).digest() for c in contents]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(self.owner), pa.list_(pa.int32()))
        key, pivot, n, owners, firsts = (pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))
        return pa.RecordBatch.from_arrays(
            [key, pa.array(names, pa.binary()), pa.array(contents, pa.binary()), pivot, n, owners, firsts],
            names=["key", "segment", "content", "pivot", "n", "owners", "firsts"])


def cut_segments(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(pa.int64())
        for batch in small_batches(batches):
            for row, text, runs in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2)):
                runs = runs.values
                for key, first, last, pivot in zip(*(runs.field(i).to_pylist() for i in range(4))):
                    segments.add(key, text[first:last + width], pivot, 1, row, first)
                if segments.size > HELD:
                    yield segments.out()
        yield segments.out()
    return cut


def piece(content: bytes, pivot: int, width: int, fine: int, group: int) -> tuple[int, int, bytes] | None:
    """The ``group``-th piece of a segment: its windows at ``fine`` consecutive distances before the minimiser.

    First window, the one after the last, and what all windows at these distances contain; None if the segment has no such window.
    """
    nearest = pivot - group * fine
    at, end = max(0, nearest - fine + 1), min(len(content) - width, nearest) + 1
    return (at, end, content[nearest:nearest - fine + 1 + width]) if at < end else None


def split_segments(width: int, fine: int):
    """The pieces of segments, dealt by what their windows have in common."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(pa.binary())
        for batch in small_batches(batches):
            names, contents = (text_bytes(batch.column(c)) for c in ("segment", "content"))
            for name, content, pivot, n in zip(names, contents, *(batch.column(c).to_pylist() for c in ("pivot", "n"))):
                for group in range(max(0, pivot - len(content) + width) // fine, pivot // fine + 1):
                    if found := piece(content, pivot, width, fine, group):
                        at, end, core = found
                        key = xxhash.xxh64_intdigest(core, group) - (1 << 63)
                        segments.add(key, content[at:end + width - 1], pivot - at, n, name, at)
                if segments.size > HELD:
                    yield segments.out()
        yield segments.out()
    return split


def repeated_windows(contents: Sequence[bytes], width: int) -> list[np.ndarray]:
    """For each of some different segments, which of its windows occur elsewhere in them."""
    text = b"".join(contents)
    sizes = np.array([len(c) for c in contents])
    starts = np.cumsum(sizes) - sizes
    whole = np.zeros(len(text) + 1, np.int64)  # windows that lie in one segment
    np.add.at(whole, starts, 1)
    np.add.at(whole, starts + sizes - width + 1, -1)
    order = suffix_array(text, width)
    order = order[np.cumsum(whole)[order] > 0]
    alike = np.flatnonzero(common_prefixes(text, order, width) >= width)
    marked = np.zeros(len(text), bool)
    marked[order[alike]] = True
    marked[order[alike - 1]] = True
    return [marked[a:a + n - width + 1] for a, n in zip(starts.tolist(), sizes.tolist())]


def repeated_by_distance(contents: Sequence[bytes], pivots: Sequence[int], width: int, limit: int, fine: int = FINE) -> list[np.ndarray]:
    """``repeated_windows`` of a large bucket of different segments, by pieces that have their common bytes in common.

    Pieces are sorted together up to ``limit`` bytes; more of them with the same common bytes fall into single windows.
    """
    marks = [np.zeros(len(c) - width + 1, bool) for c in contents]
    for group in range(max(pivots) // fine + 1):
        cores: dict[bytes, dict[bytes, list[tuple[int, int]]]] = {}
        for i, (content, pivot) in enumerate(zip(contents, pivots)):
            if cut := piece(content, pivot, width, fine, group):
                at, end, core = cut
                cores.setdefault(core, {}).setdefault(content[at:end + width - 1], []).append((i, at))
        sorted_together: list[tuple[bytes, list[tuple[int, int]]]] = []
        size = 0

        def sort() -> None:
            for (_, owners), marked in zip(sorted_together, repeated_windows([part for part, _ in sorted_together], width)):
                for i, at in owners:
                    marks[i][at:at + len(marked)] |= marked

        for found in cores.values():
            for part, owners in found.items():
                if len(owners) > 1:
                    for i, at in owners:
                        marks[i][at:at + len(part) - width + 1] = True
            if len(found) < 2:
                continue
            held = sum(map(len, found))
            if held > limit and fine > 1:
                far = [pivots[owners[0][0]] - owners[0][1] for owners in found.values()]
                for owners, marked in zip(found.values(), repeated_by_distance(list(found), far, width, limit, 1)):
                    for i, at in owners:
                        marks[i][at:at + len(marked)] |= marked
                continue
            if sorted_together and size + held > limit:
                sort()
                sorted_together, size = [], 0
            sorted_together += found.items()
            size += held
        if sorted_together:
            sort()
    return marks


def find_spans(width: int, limit: int):
    """Spans of repeated windows of every segment that has any, from segments in the order of their keys."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: dict[bytes, list] = {}  # by name: content, pivot and how many owners have it
        pool: dict[bytes, list] = {}  # whole buckets that are sorted together
        size = pooled = 0
        key: int | None = None

        def spans(found: dict[bytes, list], marks: Sequence[np.ndarray]) -> pa.RecordBatch:
            names, out = [], []
            for (name, (content, _, n)), marked in zip(found.items(), marks):
                if n > 1:
                    names.append(name)
                    out.append([(0, len(content))])
                elif marked.any():
                    edges = np.flatnonzero(np.diff(np.r_[False, marked, False].astype(np.int8))).tolist()
                    names.append(name)
                    out.append(merged(np.array(edges[::2]), np.array(edges[1::2]) - 1 + width))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), span_lists(out)], names=["segment", "spans"])

        def sort_pool() -> pa.RecordBatch:
            return spans(pool, repeated_windows([c for c, *_ in pool.values()], width))

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal size, pooled
            if size > limit:
                contents, pivots, _ = zip(*bucket.values())
                yield spans(bucket, repeated_by_distance(contents, pivots, width, limit))
            else:
                if pool and pooled + size > limit:
                    yield sort_pool()
                    pooled = 0
                pool.update(bucket)
                pooled += size
                bucket.clear()
            size = 0

        for batch in small_batches(batches):
            names, contents = (text_bytes(batch.column(c)) for c in ("segment", "content"))
            for of, name, content, pivot, n in zip(batch.column("key").to_pylist(), names, contents, *(batch.column(c).to_pylist() for c in ("pivot", "n"))):
                if of != key:
                    yield from close()
                    key = of
                known = bucket.get(name)
                if known is None:
                    bucket[name] = [content, pivot, n]
                    size += len(content)
                else:
                    known[2] += n
        yield from close()
        if pool:
            yield sort_pool()
    return find


def span_lists(spans: Sequence[Sequence[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"first": a, "end": b} for a, b in each] for each in spans], SPAN_TYPE)


def merged(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Spans joined where they touch."""
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    cuts = np.flatnonzero(first[1:] > reach[:-1])
    return list(zip(first[np.r_[0, cuts + 1]].tolist(), reach[np.r_[cuts, len(reach) - 1]].tolist()))


def cut_repeats(source: DataFrame, width: int = WIDTH) -> DataFrame:
    """The segments of ``source`` (_row, data) whose minimiser is not alone, each with its rows; equal ones of a task are one."""
    runs = stored(source.select("_row", "data").mapInArrow(find_runs(width), RUNS), "runs")
    # Counts are stored before they are joined: a join of two plain shuffles is one whose skewed keys Spark splits.
    repeated = stored(runs.groupBy("key").count().where("count > 1").select("key"), "repeated")
    per_row = runs.join(repeated, "key").groupBy("_row").agg(F.collect_list(F.struct("key", "first", "last", "pivot")).alias("runs"))
    return stored(source.select("_row", "data").join(per_row, "_row").mapInArrow(cut_segments(width), SEGMENTS.format("bigint")), "segments")


def segment_spans(cuts: DataFrame, width: int = WIDTH) -> DataFrame:
    """``segment`` and ``spans`` of each segment of ``cuts`` in which a window repeats, in bytes from the segment's start.

    A segment has one row, or two that agree where it is a piece of itself.
    """
    spark = cuts.sparkSession
    columns = ("key", "segment", "content", "pivot", "n")
    waiting, ready, levels = cuts, [], []
    for fine in (FINE, 1):
        rows = waiting.groupBy("key").count()
        many = stored(rows.where(F.col("count") > BUSY).select("key"), "many")
        if many.isEmpty():
            break
        ready.append(waiting.join(many, "key", "left_anti").select(*columns))
        # Equal segments of different tasks meet before the different ones of a bucket are counted.
        united = stored(
            waiting.join(many, "key", "left_semi").groupBy("segment")
            .agg(*[F.any_value(c).alias(c) for c in ("key", "content", "pivot")], F.sum("n").alias("n")), "united")
        busy = stored(united.groupBy("key").count().where(F.col("count") > BUSY).select("key"), "busy")
        ready.append(united.join(busy, "key", "left_anti").select(*columns))
        waiting = stored(united.join(busy, "key", "left_semi").mapInArrow(split_segments(width, fine), SEGMENTS.format("binary")), "pieces")
        levels.append(waiting)
    ready.append(waiting.select(*columns))
    dealt = reduce(DataFrame.unionByName, ready).repartition(partitions(spark), "key").sortWithinPartitions("key")
    found = stored(dealt.mapInArrow(find_spans(width, SORTED), SPANS), "spans")
    for level in reversed(levels):
        owned = (
            level.select("segment", F.explode(F.arrays_zip("owners", "firsts")).alias("of")).join(found, "segment")
            .groupBy(F.col("of.owners").alias("segment")).agg(F.flatten(F.collect_list(_shifted("of.firsts"))).alias("spans"))
        )
        found = stored(found.unionByName(owned.mapInArrow(join_spans, SPANS)), "spans")
    return found


def _shifted(first: str) -> Column:
    return F.transform("spans", lambda s: F.struct((F.col(first) + s["first"]).alias("first"), (F.col(first) + s["end"]).alias("end")))


def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, lists of spans, with spans joined where they touch; null is no span."""
    for batch in batches:
        out = []
        for found in batch.column(batch.num_columns - 1):
            values = found.values if found.is_valid else None
            out.append(merged(values.field(0).to_numpy(), values.field(1).to_numpy()) if values is not None else [])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], span_lists(out)], names=batch.schema.names)


def find_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """Every row of ``docs`` as ``_doc`` (a struct of its columns but the text), ``data`` (UTF-8 bytes of the whole text) and ``spans``.

    ``spans``, structs of first and end, are the maximal runs of bytes covered by a ``width``-byte string that also starts anywhere
    else, in the same or another row. Null texts are empty; texts shorter than the width have no spans; repeated
    rows are copies of each other. The texts are shuffled once, to a table in buckets by row.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("string").alias("_none")]
    source = bucketed(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*others).alias("_doc"), utf8(F.col(text)).alias("data")), "_row", "texts")
    cuts = cut_repeats(source, width)
    # A segment that very many rows have is a skewed key of a plain join, which Spark splits.
    owned = (
        cuts.select("segment", "owners", "firsts").join(segment_spans(cuts, width), "segment")
        .select(F.explode(F.arrays_zip("owners", "firsts")).alias("of"), "spans")
        .select(F.col("of.owners").alias("_row"), _shifted("of.firsts").alias("spans"))
    )
    per_row = stored(owned, "owned").groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    whole = source.join(per_row, "_row", "left").select("_doc", "data", "spans")
    return whole.mapInArrow(lambda batches: join_spans(small_batches(batches)), extended(whole.select("_doc", "data").schema, "spans array<struct<first: int, end: int>>"))


def _kept(data: bytes, spans: Sequence[dict[str, int]]) -> bytes:
    at, parts = 0, []
    for span in spans:
        parts.append(data[at:span["first"]])
        at = span["end"]
    return b"".join([*parts, data[at:]])


def summarise(found: DataFrame) -> DataFrame:
    """``_doc``, bytes, removed bytes, spans and the checksum of what is left of every row."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            spans = batch.column(2).to_pylist()
            texts = list(text_bytes(batch.column(1)))
            sums = [hashlib.sha256(_kept(t, s)).hexdigest() for t, s in zip(texts, spans)]
            columns = [[len(t) for t in texts], [sum(x["end"] - x["first"] for x in s) for s in spans], [len(s) for s in spans]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(sums, pa.string())], names=["_doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(digest, extended(found.select("_doc").schema, "n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with every repeated byte string cut from the texts; all rows and columns stay.

    A character of which only a part is removed goes as a whole; a null text becomes empty.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [_kept(t, s).decode("utf-8", "ignore") for t, s in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_doc", "_text"])

    found = find_repeats(docs, text, width)
    kept = found.mapInArrow(cut, extended(found.select("_doc").schema, "_text string"))
    return kept.select(*[(F.col("_text") if c == text else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
