"""Decontamination with a generalised suffix automaton over the words of test items.

The automaton holds all word sequences that occur in any item. A document is streamed through it word
by word, tracking the longest match that ends at each word; where that match is as long as a window, the window is an
occurrence of an item, and its words are hit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import extended, new_path, small_batches, stored, text_bytes

#: Lower-cases A-Z; every other ASCII character but letters and digits separates words.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton of items, with the items that each window stands for.

    ``step`` maps state and word to the next state, ``link`` is the suffix link, ``longest`` the longest length of
    a state's sequences. ``windows`` lists, per state, (length, items) for the windows among its sequences.
    """

    def __init__(self, items: Sequence[tuple[str, Sequence[bytes]]], width: int):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        coded = []
        for name, words in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((name, codes))
            last = 0
            for code in codes:
                last = self._extend(last, code)
        self.shortest_window = min((min(len(c), width) for _, c in coded if c), default=width)
        self.windows: list[dict[int, set[str]]] = [{} for _ in self.step]
        for name, codes in coded:
            size = min(len(codes), width)
            state = 0
            for at, code in enumerate(codes):
                state = self.step[state][code]
                if at + 1 >= size > 0:
                    here = self._cut(state, size)
                    self.windows[here].setdefault(size, set()).add(name)
        # The nearest state with windows, from each state along its links.
        self.near = [-1] * len(self.step)
        for state in sorted(range(1, len(self.step)), key=self.longest.__getitem__):
            self.near[state] = state if self.windows[state] else self.near[self.link[state]]

    def _extend(self, last: int, code: int) -> int:
        step, link, longest = self.step, self.link, self.longest
        if code in step[last]:  # a sequence of an earlier item
            at = step[last][code]
            return at if longest[at] == longest[last] + 1 else self._clone(last, code, at)
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        while last != -1 and code not in step[last]:
            step[last][code] = new
            last = link[last]
        if last != -1:
            at = step[last][code]
            link[new] = at if longest[at] == longest[last] + 1 else self._clone(last, code, at)
        return new

    def _clone(self, last: int, code: int, at: int) -> int:
        step, link, longest = self.step, self.link, self.longest
        copy = len(step)
        step.append(dict(step[at]))
        longest.append(longest[last] + 1)
        link.append(link[at])
        link[at] = copy
        while last != -1 and step[last].get(code) == at:
            step[last][code] = copy
            last = link[last]
        return copy

    def _cut(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a sequence of ``state``."""
        while self.longest[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, codes: Sequence[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans [first, end) in a sequence of known words, merged, and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = length = 0
        step, link, longest, windows, near = self.step, self.link, self.longest, self.windows, self.near
        for at, code in enumerate(codes):
            while state and code not in step[state]:
                state = link[state]
                length = longest[state]
            if code not in step[state]:
                continue
            state, length = step[state][code], length + 1
            here = near[state]
            covered = 0
            while here > 0:  # every window that ends here is a suffix of the longest match
                for size, names in windows[here].items():
                    if size <= length:
                        items |= names
                        covered = max(covered, size)
                here = near[link[here]]
            if covered:
                first = at + 1 - covered
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, at + 1))
        return spans, items


HITS = "_row long, spans array<array<int>>, items array<string>"


def hits(automaton: ItemAutomaton, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Hit spans of a document's words and the items that occur in it.

    Only runs of words that the items know can hold a window; shorter runs than the shortest window are passed over.
    """
    least = automaton.shortest_window
    get = automaton.vocabulary.get
    codes = [get(w, -1) for w in words]
    array = np.array(codes, np.int64)
    edges = np.flatnonzero(np.diff(np.r_[False, array >= 0, False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for start, end in zip(*(x.tolist() for x in (starts[ends - starts >= least], ends[ends - starts >= least]))):
        found, names = automaton.scan(codes[start:end])
        spans += [(start + a, start + b) for a, b in found]
        items |= names
    return spans, items


KINDS = {"n_words": pa.int64(), "spans": pa.list_(pa.list_(pa.int32())), "items": pa.list_(pa.string())}


def _scan(docs: DataFrame, benchmark: DataFrame, width: int, sent: Sequence[str], text: str, item_id: str, item_text: str, block_bytes: int) -> DataFrame:
    """The columns ``sent`` of ``docs`` by their places, among them ``text``, which passes through Python once, and ``n_words``, ``spans`` and ``items``."""
    spark = docs.sparkSession
    tests = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    place = list(sent).index(text)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(sent)])
    schema = extended(rows.schema, "n_words long, spans array<array<int>>, items array<string>")
    names = schema.names

    def automaton_of(block: int) -> Broadcast:
        own = tests.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        return spark.sparkContext.broadcast(ItemAutomaton([(r["item"], words_of(r["text"].encode())) for r in own], width))

    shared = automaton_of(0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in small_batches(batches):
            found = []
            for raw in text_bytes(batch.column(place)):
                words = words_of(raw)
                where, items = hits(automaton, words)
                found.append((len(words), merged(where), sorted(items)))
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(KINDS.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    found = rows.mapInArrow(scan, schema)
    if blocks == 1:
        return found
    found = stored(found.withColumn("_row", F.monotonically_increasing_id()), "scanned")
    path = new_path(spark, "hits")
    for block in range(1, blocks):
        more = automaton_of(block)

        def scan_more(batches: Iterator[pa.RecordBatch], more=more) -> Iterator[pa.RecordBatch]:
            automaton = more.value
            for batch in small_batches(batches):
                out = [(row, *hits(automaton, words_of(raw))) for row, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)))]
                out = [(row, merged(where), sorted(items)) for row, where, items in out if where]
                kinds = (pa.int64(), KINDS["spans"], KINDS["items"])
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["_row", "spans", "items"])

        found.select("_row", f"_{place}").mapInArrow(scan_more, HITS).write.parquet(f"{path}/block={block}")
        more.destroy()
    hit = spark.read.schema(HITS).parquet(path).groupBy("_row").agg(*[F.flatten(F.collect_list(c)).alias(f"_{c}") for c in ("spans", "items")])
    both = found.join(stored(hit, "hit"), "_row", "left").select(*names, "_spans", "_items")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            *kept, spans, items, more_spans, more_items = batch.columns
            spans = [merged([*a, *(b or ())]) for a, b in zip(spans.to_pylist(), more_spans.to_pylist())]
            items = [sorted({*a, *(b or ())}) for a, b in zip(items.to_pylist(), more_items.to_pylist())]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, KINDS["spans"]), pa.array(items, KINDS["items"])], names=names)

    return both.mapInArrow(unite, schema)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, carry: Sequence[str] = ("doc_id",), text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_bytes: int = 1 << 20,
) -> DataFrame:
    """Hit word spans and items of every document.

    Result: the ``carry`` columns, ``n_words`` long, ``spans`` array of [first, end) word positions (sorted, apart),
    ``items`` array of item ids as strings, sorted; carried columns of these names give way. Null or empty texts have no words and no hits; items without words have no
    window; repeated items count by their id; a null item id takes no part. An empty benchmark gives no hits.

    The benchmark is taken in blocks of about ``block_bytes`` of text, one automaton per block (some 100 MB for a block of 1 MB), built
    in the driver and broadcast. The first block is scanned as the documents are read; if there are more, what it found is stored with the
    documents, each further block is a scan of its own that writes hits alone, and they are joined in the end. So a task holds one automaton, and
    the plan does not grow with the benchmark. Texts are not shuffled unless the hits are too many to send around.
    """
    sent = [*carry] if text in carry else [*carry, text]
    found = _scan(docs, benchmark, width, sent, text, item_id, item_text, block_bytes)
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(carry) if c not in KINDS], *KINDS)


def merged(spans: Sequence[Sequence[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, end in sorted(map(tuple, spans)):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Add ``n_hit`` and ``contaminated``: some word is hit, and at least one word in ``share``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def remove_spans(text: str | None, spans: Sequence[Sequence[int]]) -> str | None:
    """The text without the words of the spans and what stands between them; the rest is left as it is."""
    if not text or not spans:
        return text
    raw = text.encode()
    bytes_ = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[False, bytes_, False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    keep = np.ones(len(raw), bool)
    for first, end in spans:
        keep[starts[first]:ends[end - 1]] = False
    return bytes(compress(raw, keep)).decode("utf-8", "ignore")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, long_span: int | None = None) -> DataFrame:
    """``docs`` (with a ``text``) without contaminated documents: those of which one word in ``share`` or more is hit.

    With ``long_span``, the hit spans of at least so many words are cut from the texts of the documents that stay.
    Columns stay as they are.
    """
    found = judged(_scan(docs, benchmark, width, docs.columns, "text", "item_id", "text", 1 << 20), share).where(~F.col("contaminated"))
    kept = {c: F.col(f"_{i}") for i, c in enumerate(docs.columns)}
    if long_span is not None:
        long = F.filter("spans", lambda s: s[1] - s[0] >= long_span)
        kept["text"] = F.when(F.size(long) > 0, F.udf(remove_spans, "string")(kept["text"], long)).otherwise(kept["text"])
    return found.select(*[column.alias(c) for c, column in kept.items()])
