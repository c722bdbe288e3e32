"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of lengths that fits a sequence; the program asks for as few
configurations as cover the histogram of lengths. Multiplicative weights price the lengths: the less a length is covered, the
more it is worth. A knapsack dynamic program over the capacity finds the most valuable configuration and, from the
same table, the best one through every length; those within a small factor of the best are taken up together. The fractional solution is rounded
down without exceeding the histogram, and what is left is packed best fit, longest first. Only the histogram, at most one number
for each length, reaches the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import extended, small_batches, stored
from penprint.llm.sharding import number_slots
from penprint.llm.tokens import IDS, word_encoder

Configuration = tuple[tuple[int, int], ...]  # (length, how many), longest first


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of every room up to ``capacity``, any number of each length, and the item taken last (-1: none)."""
    worth = np.full(capacity + 1, -np.inf)
    worth[lengths] = values
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, np.int64)
    back = worth[::-1]  # back[capacity - l] is the worth of length l
    for room in range(1, capacity + 1):
        total = best[:room] + back[capacity - room:capacity]  # rest r with an item of length room - r
        at = int(total.argmax())
        if total[at] > best[room - 1]:
            best[room], last[room] = total[at], room - at
        else:
            best[room] = best[room - 1]
    return best, last


def _taken(last: np.ndarray, room: int) -> Counter:
    found: Counter = Counter()
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            found[int(last[room])] += 1
            room -= int(last[room])
    return found


def price(histogram: dict[int, int], capacity: int, rounds: int = 24, step: float = 0.25, near: float = 0.002) -> dict[Configuration, float]:
    """A fractional cover of the histogram: how often to use which configuration."""
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[n] for n in lengths.tolist()], float)
    place = {n: i for i, n in enumerate(lengths.tolist())}
    covered = np.zeros(len(lengths))
    used: dict[Configuration, float] = {}
    for _ in range(rounds):
        # The dual price of a length falls exponentially with its cover; per token, all start equal.
        value = lengths * np.exp(-4.0 * covered)
        best, last = knapsack(value, lengths, capacity)
        through = value + best[capacity - lengths]
        before = covered.copy()
        for i in np.argsort(-through, kind="stable").tolist():
            if through[i] < (1 - near) * best[capacity]:
                break
            if covered[i] > before[i]:
                continue  # its price has fallen by now
            taken = _taken(last, capacity - int(lengths[i]))
            taken[int(lengths[i])] += 1
            if any(n > histogram[length] for length, n in taken.items()):
                taken = Counter({length: min(n, histogram[length]) for length, n in taken.items()})
            items = tuple(sorted(taken.items(), reverse=True))
            where = [place[length] for length, _ in items]
            share = np.array([n for _, n in items], float) / demand[where]
            amount = step / share.max()
            covered[where] += amount * share
            used[items] = used.get(items, 0.0) + amount
        if covered.min() >= 1:
            break
    return used


def round_down(used: dict[Configuration, float], histogram: dict[int, int]) -> tuple[list[tuple[Configuration, int]], dict[int, int]]:
    """Whole multiplicities that stay within the histogram, fullest configurations first, and what they leave.

    The prices stop short of a full cover, so amounts are doubled before they are cut to whole numbers.
    """
    left = dict(histogram)
    plan = []
    for items, amount in sorted(used.items(), key=lambda x: (-sum(n * k for n, k in x[0]), -x[1], x[0])):
        times = min([int(2 * amount), *(left[length] // n for length, n in items)])
        if times > 0:
            plan.append((items, times))
            for length, n in items:
                left[length] -= n * times
    return plan, {length: n for length, n in left.items() if n}


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """Best fit, longest first, for groups of equal bins at once."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, items: tuple[int, ...], times: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((items, times))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                items, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
                fits = min(room // length, left)  # the fullest bin stays the best fit until it is full
                whole = min(times, left // fits)
                put(room - fits * length, items + (length,) * fits, whole)
                if times > whole:
                    put(room, items, times - whole)
                left -= fits * whole
            else:
                fits = min(capacity // length, left)
                put(capacity - fits * length, (length,) * fits, left // fits)
                left -= left // fits * fits
    return [(tuple(sorted(Counter(items).items(), reverse=True)), times) for groups in open_.values() for items, times in groups]


def plan_sequences(histogram: dict[int, int], capacity: int, rounds: int = 24, passes: int = 6) -> list[tuple[Configuration, int]]:
    """Configurations with multiplicities that hold exactly the histogram.

    The program is solved and rounded down again for what the pass before left over, until a pass adds little.
    """
    if histogram and (min(histogram) < 1 or max(histogram) > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    plan: list[tuple[Configuration, int]] = []
    left = dict(histogram)
    for _ in range(passes):
        if not left:
            break
        rounded, rest = round_down(price(left, capacity, rounds), left)
        if sum(t for _, t in rounded) <= 0.01 * sum(t for _, t in plan):
            break
        plan += rounded
        left = rest
    return plan + best_fit(left, capacity)


def slot_table(plan: list[tuple[Configuration, int]]) -> dict[str, np.ndarray]:
    """For each length, from which rank on its pieces go to which sequences."""
    rows, ranks, sequence = [], Counter(), 0
    for items, times in plan:
        offset = 0
        for length, n in items:
            rows.append((length, ranks[length], n, sequence, offset))
            ranks[length] += n * times
            offset += n * length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T))


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text and ``end_id``, cut every ``capacity`` ids: doc_id, piece, start, length, checksum."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        end = np.array([end_id], IDS).tobytes()
        width = capacity * IDS.itemsize
        for batch in small_batches(batches):
            out: list[tuple] = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(encoder.encode(value) + end)
                for piece, start in enumerate(range(0, len(ids), width)):
                    part = ids[start:start + width]
                    out.append((name, piece, piece * capacity, len(part) // IDS.itemsize, zlib.crc32(part)))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = extended(docs.select(F.col(doc_id).alias("doc_id")).schema, "piece int, start long, length long, ids_crc32 long")
    return docs.select(doc_id, text).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", rounds: int = 24) -> DataFrame:
    """One row per piece of a document, with the sequence it is packed into and its offset there.

    A null or empty text is one piece that holds the end id. Only documents over ``capacity`` are cut; every piece but the last is
    then full. Offsets leave no gaps. Equal lengths are exchangeable: which of them goes where follows a rank that is
    taken in buckets, so a length that a third of all pieces share is spread over tasks. Null or repeated ids
    are packed like others; an empty table gives no rows. Other columns are not carried.
    """
    pieces = stored(cut_pieces(docs, tokenizer, capacity, end_id, doc_id, text).withColumn("_spread", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = slot_table(plan_sequences(histogram, capacity, rounds))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # its size follows ``capacity`` and ``rounds``, not the rows
    ranked = number_slots(pieces, "length", ["doc_id", "piece"], "_rank").drop("_spread")

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        keys = slots["length"] << 48 | slots["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            within = rank - slots["rank"][at]
            sequence = slots["sequence"][at] + within // slots["each"][at]
            offset = slots["offset"][at] + within % slots["each"][at] * length
            columns = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "_rank"]
            names = [f.name for f in batch.schema if f.name != "_rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = extended(ranked.drop("_rank").schema, "sequence_id long, offset long")
    return ranked.mapInArrow(seat, schema)
