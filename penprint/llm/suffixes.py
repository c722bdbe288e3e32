"""Suffix arrays by two-stage sorting, for texts of a few megabytes, as vector operations.

Only suffixes smaller than their successors are sorted directly. A larger one follows its successor: scanning the buckets of
first bytes in rising order and taking the suffix before each scanned one, if that is larger, appends all
others to their buckets in order. Comparisons look at ``depth`` bytes, which is all that matches of that length need.
"""

from __future__ import annotations

import numpy as np


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one is larger than the empty suffix."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])  # a run of equal bytes is decided by what follows it
    decided = np.searchsorted(differs, np.arange(n))
    smaller = np.zeros(n, bool)
    inside = decided < len(differs)
    at = differs[decided[inside]]
    smaller[inside] = text[at] < text[at + 1]
    return smaller


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by their first ``depth`` bytes; suffixes equal so far stand together."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    padded = np.zeros(n + depth, np.uint8)
    padded[:n] = np.frombuffer(text, np.uint8)
    chars = padded[:n]
    smaller = smaller_than_next(chars)
    direct = np.flatnonzero(smaller)
    windows = np.ndarray((n,), f"S{depth}", padded, strides=(1,))
    direct = direct[np.argsort(windows[direct], kind="stable")]
    bounds = np.searchsorted(chars[direct], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    queues[chars[-1]].append(np.array([n - 1]))  # before the empty suffix, the smallest
    order = []
    for char in range(256):
        if not queues[char] and bounds[char] == bounds[char + 1]:
            continue
        larger = queues[char]
        newest = np.concatenate(larger) if larger else np.empty(0, np.int64)
        parts = [newest]
        while len(newest):  # larger suffixes that start with the same byte twice stay in this bucket
            newest = newest[newest > 0] - 1
            newest = newest[(chars[newest] == char) & ~smaller[newest]]
            parts.append(newest)
        bucket = np.concatenate([*parts, direct[bounds[char]:bounds[char + 1]]])
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (chars[before] > char)]
        if len(before):
            first = chars[before]
            before = before[np.argsort(first, kind="stable")]
            steps = np.flatnonzero(np.bincount(first, minlength=256))
            for target, part in zip(steps.tolist(), np.split(before, np.cumsum(np.bincount(first, minlength=256)[steps])[:-1])):
                queues[target].append(part)
    return np.concatenate(order)


def common_prefixes(text: bytes, starts: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to ``depth``, of the common prefix of each suffix with the one before it in ``starts``; 0 for the first."""
    out = np.zeros(len(starts), np.int64)
    if len(starts) < 2:
        return out
    words = -(-depth // 8)
    padded = np.zeros(len(text) + 8 * words, np.uint8)
    padded[:len(text)] = np.frombuffer(text, np.uint8)
    view = np.ndarray((len(text), words), "<u8", padded, strides=(1, 8))
    for at in range(1, len(starts), 1 << 15):
        here = starts[at:at + (1 << 15)]
        there = starts[at - 1:at - 1 + len(here)]
        alike = np.full(len(here), 8 * words)
        rows = np.arange(len(here))
        for block in range(0, words, 5):  # most pairs part early
            xor = view[here[rows], block:block + 5] ^ view[there[rows], block:block + 5]
            parted = (xor != 0).any(1)
            first = (xor[parted] != 0).argmax(1)
            word = np.ascontiguousarray(xor[parted][np.arange(len(first)), first])
            zeros = (word.view(np.uint8).reshape(-1, 8) != 0).argmax(1)
            alike[rows[parted]] = 8 * (block + first) + zeros
            rows = rows[~parted]
            if not len(rows):
                break
        limit = len(text) - np.maximum(here, there)
        out[at:at + len(here)] = np.minimum(np.minimum(alike, depth), limit)
    return out
