"""Exact quantiles of many numbers per row, by radix selection.

The bits of a double, read as a whole number and turned where it is negative, rise with the double. A pass counts, for each feature, the next 16
bits of the values whose leading bits a wanted rank falls on; counts add up inside a task, and what leaves it are counts alone. As soon
as few values are left the last pass counts them whole. No row is exploded or shuffled, and a feature of any distribution takes at most four passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 16  # bits of a pass
WHOLE = 1 << 18  # values left in all features together that the last pass counts whole
CELLS = 1 << 18  # numbers looked at together
TOP = np.uint64(1 << 63)


def images(values: np.ndarray) -> np.ndarray:
    """Unsigned whole numbers in the order of doubles; negative zero is zero, and not-a-number is the largest."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    return np.where(bits >= TOP, ~bits, bits | TOP)


def doubles(found: np.ndarray) -> np.ndarray:
    return np.where(found >= TOP, found ^ TOP, ~found).view(np.float64)


def feature_matrix(batch: pa.RecordBatch, place: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, values and validity of some rows at a time of a column of arrays, all of one width; a null array is null throughout."""
    column = batch.column(place)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
    width = int(sizes.max(initial=0))
    if not width:
        return
    step = max(1, CELLS // width)
    for start in range(0, len(column), step):
        part = column.slice(start, step)
        inside = np.arange(width) < np.where(part.is_valid().to_numpy(zero_copy_only=False), sizes[start:start + step], 0)[:, None]
        flat = part.flatten()
        values, known = np.full(inside.shape, np.nan), np.zeros(inside.shape, bool)
        values[inside] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        known[inside] = flat.is_valid().to_numpy(zero_copy_only=False)
        yield start, values, known


def _runs(feature: np.ndarray, part: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (feature, part), sorted."""
    order = np.lexsort((part, feature))
    feature, part, n = feature[order], part[order], n[order]
    first = np.flatnonzero(np.r_[True, (feature[1:] != feature[:-1]) | (part[1:] != part[:-1])]) if len(part) else np.empty(0, np.int64)
    return feature[first], part[first], np.add.reduceat(n, first) if len(first) else n


def _counted(rows: DataFrame, shift: int, wanted: np.ndarray | None, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, image without its last ``shift`` bits, and count of the values whose image without the last ``before`` bits is wanted.

    ``wanted`` has a row of such leading bits for each feature; None wants all values.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, values, known in feature_matrix(batch):
                found = images(values)
                if wanted is not None:
                    width = min(values.shape[1], len(wanted))
                    found, known = found[:, :width], known[:, :width]
                    lead = found >> np.uint64(before)
                    known = known & np.logical_or.reduce([lead == wanted[:width, i] for i in range(wanted.shape[1])])
                place = np.nonzero(known)
                held.append(_runs(place[1].astype(np.int32), found[place] >> np.uint64(shift), np.ones(len(place[0]), np.int64)))
                size += len(held[-1][0])
                if size > 4 * CELLS:
                    held = [_runs(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0]) // 2  # so that many distinct values are not sorted again at every turn
        if held:
            feature, part, n = _runs(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(part.view(np.int64)), pa.array(n)], names=["feature", "part", "n"])

    table = rows.mapInArrow(count, "feature int, part long, n long").groupBy("feature", "part").agg(F.sum("n").alias("n")).toArrow()
    feature, part, n = (table[c].to_numpy() for c in ("feature", "part", "n"))
    return _runs(feature, part.view(np.uint64), n)


def array_quantiles(df: DataFrame, features: Column, probabilities: Sequence[float]) -> np.ndarray:
    """Interpolated quantiles of each place of an array of doubles: a row per place, a column per probability.

    Null cells, missing ones and null arrays do not count; not-a-number is larger than all. A place without values has NaN. The driver sees counts
    per place and leading bits, and at most ``WHOLE`` values at the end.
    """
    rows = df.select(features.cast("array<double>").alias("f"))
    shift = 64 - DIGITS
    feature, part, n = _counted(rows, shift, None, 64)
    width = int(feature.max()) + 1 if len(feature) else 0
    out = np.full((width, len(probabilities)), np.nan)
    if not width:
        return out
    # Two ranks around each quantile, and how many values lie before their part.
    totals = np.bincount(feature, n, width).astype(np.int64)
    place = np.array(probabilities)[None] * (totals[:, None] - 1)
    ranks = np.stack([np.floor(place), np.ceil(place)], 2).reshape(width, -1).astype(np.int64)
    known = {f: np.zeros(ranks.shape[1], np.uint64) for f in range(width) if totals[f]}
    below = {f: np.zeros(ranks.shape[1], np.int64) for f in known}
    before = 64
    while True:
        left = 0
        starts, ends = np.searchsorted(feature, list(known)), np.searchsorted(feature, list(known), "right")
        for f, a, b in zip(known, starts, ends):
            parts, counts = part[a:b], n[a:b]
            lead = parts >> np.uint64(before - shift) if before - shift < 64 else np.zeros(len(parts), np.uint64)
            for i, rank in enumerate(ranks[f]):
                low, high = np.searchsorted(lead, known[f][i]), np.searchsorted(lead, known[f][i], "right")
                upto = np.cumsum(counts[low:high])
                at = int(np.searchsorted(upto, rank - below[f][i], "right"))
                below[f][i] += upto[at] - counts[low + at]
                known[f][i] = parts[low + at]
            left += int(counts[np.isin(parts, known[f])].sum())
        if not shift:
            break
        before, shift = shift, 0 if left <= WHOLE else shift - DIGITS
        wanted = np.full((width, ranks.shape[1]), np.uint64(2**64 - 1))  # no leading bits are so large: nothing is wanted
        for f, prefixes in known.items():
            wanted[f] = prefixes
        feature, part, n = _counted(rows, shift, wanted, before)
    for f in known:
        low, high = doubles(known[f]).reshape(-1, 2).T
        share = place[f] - np.floor(place[f])
        apart = low != high
        out[f] = low
        out[f, apart] += share[apart] * (high[apart] - low[apart])
    return out
