"""Document fingerprints from improbable byte windows, in chained Bloom filters.

Every window of 64 bytes has an entropy, taken from whole numbers and hence exact. How rare an entropy is among all windows of the
corpus ranks the windows; those that are the rarest of many of the runs around them are the features of a document. Features go into
a chain of Bloom filters of bounded load in the order of the text, and two documents are alike as far as bits of their filters overlap beyond chance.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import extended, small_batches, text_bytes, utf8

WINDOW = 64
RUN = 64  # windows among which the rarest is looked for
POPULAR = 16  # runs a feature wins
FILTER_BYTES = 256
FILTER_BITS = 8 * FILTER_BYTES
LOAD = 160  # features of a filter
HASHES = 5
CHUNK = 1 << 17  # windows looked at together
STEPS = 64  # entropy bins per bit
LEAST = STEPS  # windows of less than one bit, such as runs of blanks, are no features
BINS = 6 * STEPS + 1
COMMON = np.uint16(0xFFFF)  # the rank of what cannot be a feature
SHORT = 256  # bytes below which a text's features are all its short strings
GRAM = 5  # bytes of these
MIX = np.uint64(0x9E3779B97F4A7C15)
COUNTS = np.arange(WINDOW + 1)
#: c log2 c in units of 2^-16, so that sums over a window are exact whatever the order of additions.
TERMS = np.round(COUNTS * np.log2(np.maximum(COUNTS, 1)) * 65536).astype(np.int64)


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """Entropy of the window at every place but the last 63, in steps of 1/64 bit."""
    out = np.empty(max(0, len(data) - WINDOW + 1), np.uint16)
    for start in range(0, len(out), CHUNK):
        part = data[start:start + CHUNK + WINDOW - 1]
        ahead = np.ones(len(part), np.uint8)  # the same byte among this and the next 63
        behind = np.ones(len(part), np.uint8)  # and among this and the 63 before
        for k in range(1, WINDOW):
            same = (part[:-k] == part[k:]).view(np.uint8)
            ahead[:-k] += same
            behind[k:] += same
        _, first = np.unique(part[:WINDOW], return_counts=True)
        changes = TERMS[behind[WINDOW:]] - TERMS[behind[WINDOW:] - 1]
        leaving = ahead[:len(part) - WINDOW]
        changes -= TERMS[leaving] - TERMS[leaving - 1]
        sums = np.empty(len(changes) + 1, np.int64)
        sums[0] = TERMS[first].sum()
        np.cumsum(changes, out=sums[1:])
        sums[1:] += sums[0]
        # Entropy is 6 - sum / 64 bits; the sum is at most 64 * 6.
        out[start:start + CHUNK] = ((6 * WINDOW << 16) - sums) * STEPS // (WINDOW << 16)
    return out


def picked(ranks: np.ndarray) -> np.ndarray:
    """Places that are the rarest, the first on ties, of at least ``POPULAR`` of the runs of windows that hold them."""
    wins = np.zeros(len(ranks), np.int32)
    for start in range(0, len(ranks), CHUNK):
        low, high = max(0, start - RUN + 1), min(len(ranks), start + CHUNK + RUN - 1)
        keys = np.full(high - low + 2 * (RUN - 1), int(COMMON) << 32, np.int64)
        keys[RUN - 1:len(keys) - RUN + 1] = ranks[low:high].astype(np.int64) << 32
        keys += np.arange(len(keys))
        reach = 1
        while reach < RUN:
            keys = np.minimum(keys[:-reach], keys[reach:])
            reach *= 2
        keys = keys[keys >> 32 < int(COMMON)]
        found = np.bincount((keys & 0xFFFFFFFF) - RUN + 1, minlength=high - low)
        end = min(start + CHUNK, len(ranks))
        wins[start:end] = found[start - low:end - low]
    return np.flatnonzero(wins >= POPULAR)


def feature_hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows at some places."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places]).view("<u8") if len(places) else np.empty((0, 8), np.uint64)
    out = np.zeros(len(places), np.uint64)
    for k in range(words.shape[1]):
        out = (out ^ words[:, k]) * MIX
        out ^= out >> np.uint64(29)
    out *= MIX
    return out ^ out >> np.uint64(32)


def chained_filters(hashes: np.ndarray) -> bytes:
    """Bloom filters of ``LOAD`` features each, the last of what is left; a repeated feature counts where it is first."""
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    bits = np.zeros(-(-len(hashes) // LOAD) * FILTER_BITS, bool)
    base = np.arange(len(hashes)) // LOAD * FILTER_BITS
    for k in range(HASHES):
        bits[base + (hashes >> np.uint64(11 * k) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def spelled(filters: bytes) -> str:
    return base64.b64encode(filters).decode()


def likeness(one: bytes, two: bytes) -> float:
    """0 to 1: for every filter of the shorter chain, its best overlap with a filter of the other, on average.

    The overlap of two filters is the share of the bits that could agree, less what chance lets agree. Equal chains have 1; an empty
    chain is like no other.
    """
    if one == two:
        return 1.0
    if not one or not two:
        return 0.0
    a, b = sorted((np.unpackbits(np.frombuffer(f, np.uint8)).reshape(-1, FILTER_BITS).astype(np.float32) for f in (one, two)), key=len)
    if len(a) == len(b) and one > two:  # the same either way round
        a, b = b, a
    total = 0.0
    for start in range(0, len(a), 256):
        part = a[start:start + 256]
        best = np.zeros(len(part))
        for other in range(0, len(b), 4096):
            there = b[other:other + 4096]
            common = (part @ there.T).astype(float)
            ones, twos = part.sum(1, dtype=float)[:, None], there.sum(1, dtype=float)[None]
            chance, most = ones * twos / FILTER_BITS, np.minimum(ones, twos)
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.where(most > chance, (common - chance) / (most - chance), (common == most).astype(float))
            best = np.maximum(best, score.max(1))
        total += float(best.sum())
    return min(1.0, total / len(a))


@dataclass(frozen=True)
class Rarity:
    """Rank of every entropy bin; the rarest has 0."""

    ranks: np.ndarray

    def of(self, data: np.ndarray) -> np.ndarray:
        return self.ranks[entropy_bins(data)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all strings of ``GRAM`` bytes; of the whole, if that is shorter."""
    out = np.full(max(1, len(data) - GRAM + 1), len(data) if len(data) < GRAM else GRAM, np.uint64)
    for k in range(min(GRAM, len(data))):
        out = out << np.uint64(8) | data[k:k + len(out)]
    out *= MIX
    out ^= out >> np.uint64(29)
    out *= MIX
    return out ^ out >> np.uint64(32)


def digest(data: bytes, places: np.ndarray) -> bytes:
    """The chain of a text whose features start at ``places``. A short text, or one without any, has all its short strings as features."""
    if not data:
        return b""
    array = np.frombuffer(data, np.uint8)
    return chained_filters(gram_hashes(array) if len(data) < SHORT or not len(places) else feature_hashes(array, places))


def fit_rarity(docs: DataFrame, text: str = "text") -> Rarity:
    """Ranks of entropies by how many windows of all texts have them: counts of at most 385 bins reach the driver.

    Bins that no window has are the rarest, the higher entropy first; equal counts likewise. Null texts are empty.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in small_batches(batches):
            for data in joined(list(text_bytes(batch.column(0)))):
                bins, whole = data
                total += np.bincount(bins[whole], minlength=BINS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bin", "n"])

    counts = docs.select(utf8(F.col(f"`{text}`")).alias("data")).mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(BINS, np.int64)
    for row in counts:
        seen[row["bin"]] = row["n"]
    ranks = np.full(BINS, COMMON, np.uint16)
    usable = np.arange(LEAST, BINS)
    order = usable[np.lexsort((-usable, seen[usable]))]
    ranks[order] = np.arange(len(order))
    return Rarity(ranks)


def joined(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entropy bins of some texts at once, and which windows lie within one text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) >= WINDOW:
        bins = entropy_bins(data)
        yield bins, within(np.array([len(t) for t in texts]), len(data))[:len(bins)]


def within(sizes: np.ndarray, size: int) -> np.ndarray:
    """Of joined texts, the places at which a window lies within one text."""
    edges = np.zeros(size + 1, np.int32)
    starts = np.cumsum(sizes) - sizes
    long = sizes >= WINDOW
    np.add.at(edges, starts[long], 1)
    np.add.at(edges, starts[long] + sizes[long] - WINDOW + 1, -1)
    return np.cumsum(edges[:-1]) > 0


def digests_of(texts: Sequence[bytes], rarity: Rarity, like: Sequence[tuple[int, int] | None] | None = None) -> list[bytes]:
    """The chains of some texts, whose windows are ranked and picked in one sweep.

    ``like`` names, for a text, an earlier one and how many of their first bytes are the same: the windows within these are
    not ranked again.
    """
    like = like or [None] * len(texts)
    fresh = [t if same is None else t[max(0, same[1] - WINDOW + 1):] for t, same in zip(texts, like)]
    data = np.frombuffer(b"".join(fresh), np.uint8)
    ranked = rarity.of(data) if len(data) >= WINDOW else np.empty(0, np.uint16)
    ranks: list[np.ndarray] = []
    at = 0
    for text, part, same in zip(texts, fresh, like):
        own = ranked[at:at + max(0, len(part) - WINDOW + 1)]
        at += len(part)
        if same is not None and len(text) >= WINDOW:
            own = np.concatenate([ranks[same[0]][:max(0, same[1] - WINDOW + 1)], own])
        ranks.append(own)
    # Windows across two texts are common: a gap of 63 of them, which no run spans, keeps the texts apart.
    gap = np.full(WINDOW - 1, COMMON)
    places = picked(np.concatenate([x for own in ranks for x in (own, gap)])) if ranks else np.empty(0, np.int64)
    bounds = np.cumsum([len(own) + len(gap) for own in ranks])
    out = []
    for text, own, end, found in zip(texts, ranks, bounds, np.split(places, np.searchsorted(places, bounds)[:-1]) if len(bounds) else []):
        out.append(digest(text, found - (end - len(own) - len(gap))))
    return out


def fingerprints(docs: DataFrame, rarity: Rarity, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``carry`` columns (all, by default) with ``fingerprint``, the chain of filters of the whole text in base64.

    A null text is empty and has the empty fingerprint. A text of less than ``SHORT`` bytes, or without a rare window, has all its strings of
    ``GRAM`` bytes as features, and is like texts of the same kind only. Equal texts have equal fingerprints. A carried column named ``fingerprint`` gives way. Repeated rows stay; an empty table gives an empty one.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c != "fingerprint"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)], utf8(F.col(f"`{text}`")).alias("_data"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 20):
            found = digests_of(list(text_bytes(batch.column(len(carry)))), rarity)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([spelled(f) for f in found], pa.string())], names=[*batch.schema.names[:-1], "fingerprint"])

    out = rows.mapInArrow(mark, extended(rows.drop("_data").schema, "fingerprint string"))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)], "fingerprint")
