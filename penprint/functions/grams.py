"""Counts of n-grams inside tasks, over whole numbers.

The tokens of some rows at a time (characters, or words of an array) become numbers of an alphabet of these rows, and an n-gram one number made
of them. Equal n-grams are runs of the sorted numbers; only distinct ones become texts again. No number stands for two n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NOTHING = 0x110000  # stands for the empty text, which has one token without a character
ROOM = 1 << 62
BYTES = 2 << 20  # of texts looked at together


def pieces(batches: Iterator[pa.RecordBatch], size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, about ``size`` bytes at a time."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


@dataclass
class Tokens:
    """The tokens of some rows by number, the row of each, and what the numbers stand for: characters, or words put together with a blank."""

    codes: np.ndarray
    rows: np.ndarray
    count: int
    characters: np.ndarray | None = None
    words: pa.Array | None = None
    ranked: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return max(1, len(self.characters) if self.words is None else len(self.words))

    @staticmethod
    def of(column: pa.Array, kind: str) -> Tokens:
        if kind == "word":
            lengths = np.diff(column.offsets.to_numpy())
            coded = column.flatten().dictionary_encode()
            return Tokens(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), lengths), len(column), words=coded.dictionary)
        texts = [t or chr(0) for t in column.to_pylist()]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        empty = (np.cumsum(lengths) - lengths)[pc.equal(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(bool)]
        points[empty] = NOTHING
        known = np.zeros(NOTHING + 1, bool)
        known[points] = True
        characters = np.flatnonzero(known)
        place = np.zeros(NOTHING + 1, np.int64)
        place[characters] = np.arange(len(characters))
        return Tokens(place[points], np.repeat(np.arange(len(column)), lengths), len(column), characters)

    def levels(self, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """For each length up to ``last``: the number of the n-gram at each place where one starts (-1: it would leave its row), the row, and a bound of the numbers."""
        keys, rows, bound = self.codes, self.rows, self.size
        for k in range(1, last + 1):
            if k > 1:
                if bound * self.size * max(1, self.count) >= ROOM:  # numbered anew without gaps
                    self.ranked[k - 1], keys = np.unique(keys, return_inverse=True)
                    bound = len(self.ranked[k - 1])
                keys = keys[:-1] * self.size + self.codes[k - 1:]
                bound *= self.size
            inside = slice(None) if k == 1 else rows[:len(keys)] == rows[k - 1:]
            yield k, np.where(inside, keys, -1) if k > 1 else keys, rows[:len(keys)], bound

    def terms(self, keys: np.ndarray, k: int) -> pa.Array:
        """The texts of n-grams of length ``k``."""
        digits = []
        for level in range(k, 0, -1):
            if level in self.ranked and level < k:
                keys = self.ranked[level][keys]
            digits.append(keys % self.size if level > 1 else keys)
            keys = keys // self.size
        digits.reverse()
        if self.words is not None:
            taken = [self.words.take(pa.array(d)) for d in digits]
            return taken[0] if k == 1 else pc.binary_join_element_wise(*taken, " ")
        points = self.characters[np.stack(digits, 1)] if len(keys) else np.empty((0, k), np.int64)
        sizes = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)) * (points != NOTHING)
        data = points[points != NOTHING].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        offsets = np.r_[0, np.cumsum(sizes.sum(1))].astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(points), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())

    def numbers(self, terms: Sequence[str], k: int) -> np.ndarray:
        """The numbers of texts of ``k`` tokens, after ``levels`` has passed that length; -1 for those that cannot be in these rows."""
        if self.words is not None:
            codes = pc.index_in(pa.array([w for t in terms for w in t.split(" ")], pa.string()), self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            points = np.array([ord(c) for t in terms for c in t] if k > 1 else [ord(t) if t else NOTHING for t in terms], np.int64)
            at = np.minimum(np.searchsorted(self.characters, points), self.size - 1)
            codes = np.where(self.characters[at] == points, at, -1) if len(self.characters) else np.full(len(points), -1)
        codes = codes.reshape(len(terms), k)
        keys = codes[:, 0]
        for level in range(2, k + 1):
            if level - 1 in self.ranked:
                kept = self.ranked[level - 1]
                at = np.minimum(np.searchsorted(kept, keys), max(len(kept) - 1, 0))
                keys = np.where(kept[at] == keys, at, -1) if len(kept) else np.full(len(keys), -1)
            keys = np.where((keys >= 0) & (codes[:, level - 1] >= 0), keys * self.size + codes[:, level - 1], -1)
        return keys


def runs(keys: np.ndarray, rows: np.ndarray, bound: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each row (or group of rows) and how often each occurs, by n-gram."""
    inside = keys >= 0
    if not inside.all():
        keys, rows = keys[inside], rows[inside]
    if bound * groups < ROOM:
        pairs = np.sort(keys * groups + rows)
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.empty(0, np.int64)
        found, rows = np.divmod(pairs[first], groups)
        return found, rows, np.diff(np.r_[first, len(pairs)])
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])]) if len(keys) else np.empty(0, np.int64)
    return keys[first], rows[first], np.diff(np.r_[first, len(keys)])


def starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


def within(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each number among sorted ones, -1 for others."""
    if not len(wanted):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return np.where(wanted[at] == keys, at, -1)


def totals(batches: Iterator[pa.RecordBatch], kind: str, n: tuple[int, int], below: tuple[int, Sequence[str]] | None = None) -> Iterator[pa.RecordBatch]:
    """``term``, ``tf`` and ``df``, added up over some rows at a time. The column holds tokens.

    ``below`` gives a length and texts of it: an n-gram is counted only if all its parts of that length are among them.
    """
    for batch in pieces(batches):
        tokens = Tokens.of(batch.column(0), kind)
        allowed = None
        for k, keys, rows, bound in tokens.levels(n[1]):
            if below is not None and k == below[0]:
                allowed = within(keys, np.unique(tokens.numbers(below[1], k))) >= 0
                allowed &= keys >= 0
            if k < n[0]:
                continue
            if allowed is not None:
                for shift in range(k - below[0] + 1):
                    keys = np.where(allowed[shift:shift + len(keys)], keys, -1)
            found, _, tf = runs(keys, rows, bound, tokens.count)
            if len(found):
                first = starts(found)
                yield pa.RecordBatch.from_arrays(
                    [tokens.terms(found[first], k), pa.array(np.add.reduceat(tf, first)), pa.array(np.diff(np.r_[first, len(found)]))], names=["term", "tf", "df"])


def group_totals(batches: Iterator[pa.RecordBatch], kind: str, n: tuple[int, int], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The group (first column), ``term`` and ``tf``, added up over some rows at a time. The second column holds tokens."""
    for batch in pieces(batches):
        tokens = Tokens.of(batch.column(1), kind)
        coded = batch.column(0).dictionary_encode()
        group = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for k, keys, rows, bound in tokens.levels(n[1]):
            if k >= n[0]:
                found, own, tf = runs(keys, group[rows], bound, max(1, len(coded.dictionary)))
                if len(found):
                    yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(own)), tokens.terms(found, k), pa.array(tf)], names=list(names))


def chosen_counts(batches: Iterator[pa.RecordBatch], kind: str, terms: Sequence[str], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The key (first column) of each row that has one of ``terms``, their numbers and how often each occurs. The second column holds tokens."""
    by_length: dict[int, list[int]] = {}
    for i, term in enumerate(terms):
        by_length.setdefault(term.count(" ") + 1 if kind == "word" else max(1, len(term)), []).append(i)
    for batch in pieces(batches):
        tokens = Tokens.of(batch.column(1), kind)
        found = []
        for k, keys, rows, _ in tokens.levels(max(by_length, default=0)):
            if k in by_length:
                own = np.array(by_length[k])
                numbers = tokens.numbers([terms[i] for i in own], k)
                own, numbers = own[numbers >= 0], numbers[numbers >= 0]
                order = np.argsort(numbers)
                at = within(keys, numbers[order])
                found.append(rows[at >= 0] * len(terms) + own[order][at[at >= 0]] if len(own) else np.empty(0, np.int64))
        cells, tf = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
        row, place = np.divmod(cells, max(1, len(terms)))
        first = starts(row)
        offsets = pa.array(np.r_[first, len(row)].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row[first])), pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))],
            names=list(names))


def scored(batches: Iterator[pa.RecordBatch], kind: str, n: tuple[int, int], known: pa.Array, logs: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """The key (first column) of each row that has a known n-gram and ``_s``, the sums of its n-grams' ``logs``, a column of these each."""
    for batch in pieces(batches):
        tokens = Tokens.of(batch.column(1), kind)
        sums, hit = np.zeros((batch.num_rows, logs.shape[1])), np.zeros(batch.num_rows, bool)
        for k, keys, rows, bound in tokens.levels(n[1]):
            if k < n[0]:
                continue
            found, own, tf = runs(keys, rows, bound, tokens.count)
            first = starts(found)
            place = pc.index_in(tokens.terms(found[first], k), known).fill_null(-1).to_numpy(zero_copy_only=False)
            place = np.repeat(place, np.diff(np.r_[first, len(found)]))
            own, tf, place = own[place >= 0], tf[place >= 0], place[place >= 0]
            hit[own] = True
            for i in range(logs.shape[1]):
                sums[:, i] += np.bincount(own, tf * logs[place, i], batch.num_rows)
        said = np.flatnonzero(hit)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(said)), pa.array(list(sums[said]), pa.list_(pa.float64()))], names=[name, "_s"])


def placed(batches: Iterator[pa.RecordBatch], words: pa.Array, index: np.ndarray, other: int | None, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The key (first column) of each row, the place (from 0, in the upper half) and ``index`` of each of its tokens (second column) among ``words``, and the rest.

    The rest, ``at`` and ``token``, is empty where ``other`` gives the index of all other tokens.
    """
    for batch in pieces(batches, 8 * BYTES):
        lengths = np.diff(batch.column(1).offsets.to_numpy())
        tokens = batch.column(1).flatten()
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        at = np.arange(len(tokens)) - np.repeat(starts, lengths)
        coded = tokens.dictionary_encode()
        distinct = pc.index_in(coded.dictionary, words).fill_null(-1).to_numpy(zero_copy_only=False)
        place = distinct[coded.indices.to_numpy(zero_copy_only=False)] if len(tokens) else np.empty(0, np.int64)
        known = place >= 0
        number = np.full(len(tokens), other or 0, np.int64)
        number[known] = index[place[known]]
        told = np.ones(len(tokens), bool) if other is not None else known
        count = np.r_[0, np.cumsum(told)]
        ends = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
        mine = count[ends]
        rest = pa.StructArray.from_arrays([pa.array(at[~told].astype(np.int32)), tokens.filter(pa.array(~told))], names=["at", "token"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(mine.astype(np.int32)), pa.array((at[told] << 32) + number[told])),
             pa.ListArray.from_arrays(pa.array((ends - mine).astype(np.int32)), rest)], names=list(names))
