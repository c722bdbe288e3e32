"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A key descends the tree. At each level every subtree draws an exponential variate from a hash of the key and its own name, divided by its
weight, the sum of the weights below it; the smallest draw wins, and only the draws on the way down are taken. A subtree whose weight
stays keeps its draws: keys move into subtrees that gain weight and out of those that lose share, and
inside a subtree whose weights stay nothing moves. A new shard in a region of its own takes keys only into itself.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.llm.common import stored


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree. Numbers name the shard for good; weights are shares, zero takes nothing."""

    number: int
    region: str
    rack: str
    weight: float = 1.0


def even_tree(shards: int, regions: int = 2, racks: int = 2, deep: int = 8) -> list[Shard]:
    """``shards`` leaves of weight 1: the first ``deep`` dealt over regions and racks, each further one a region of its own.

    So a tree with one more shard moves keys only into it, beyond ``deep``.
    """
    dealt = [Shard(i, f"r{i % regions}", f"r{i % regions}k{i // regions % racks}") for i in range(min(shards, deep))]
    return dealt + [Shard(i, f"s{i}", f"s{i}k0") for i in range(deep, shards)]


def draw(key: Column, name: str, weight: float) -> Column:
    """Exponential variate of a key for a subtree, at the rate of its weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**53))) / F.lit(weight)


def place(key: Column, tree: Sequence[Shard]) -> Column:
    """Number of the shard a key belongs to. A null key is a key like any other."""
    leaves = [shard for shard in tree if shard.weight > 0]
    if not leaves:
        raise ValueError("the tree has no shard with a weight")

    def descend(below: list[Shard], path: str, levels: Sequence[Callable[[Shard], str]]) -> Column:
        if not levels:
            return F.lit(below[0].number)
        subtrees: dict[str, list[Shard]] = defaultdict(list)
        for shard in below:
            subtrees[levels[0](shard)].append(shard)
        further = [descend(own, f"{path}/{name}", levels[1:]) for name, own in subtrees.items()]
        if len(further) == 1:
            return further[0]
        draws = [
            F.struct(draw(key, f"{path}/{name}", math.fsum(s.weight for s in own)).alias("draw"), F.lit(i).alias("child"))
            for i, (name, own) in enumerate(subtrees.items())]
        # The winner is bound once; of the subtrees only that of the winner is looked at.
        winner = F.array(F.array_min(F.array(*draws))["child"])
        return F.get(F.transform(winner, lambda child: _case(child, further)), F.lit(0))

    return descend(leaves, "", (lambda s: s.region, lambda s: s.rack, lambda s: str(s.number)))


def _case(child: Column, further: Sequence[Column]) -> Column:
    out = further[-1]
    for i in range(len(further) - 2, -1, -1):
        out = F.when(child == i, further[i]).otherwise(out)
    return out


def number_slots(rows: DataFrame, shard: str = "shard", order: Sequence[str] = (), name: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without gaps.

    Rows are ranked inside buckets of their shard and shifted by the rows of the buckets before, so no
    task holds a shard. There are as many buckets in a shard as rows in a bucket, about the square root
    of its rows. ``rows`` must be a stored table with the columns ``_spread`` (any value that differs between rows).
    """
    buckets = max(1, math.isqrt(rows.count()))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("_spread"), F.lit(buckets)))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        dealt.groupBy(shard, "_bucket").count()
        .select(shard, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    )
    inside = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order, "_spread"))
    return (
        dealt.withColumn("_place", inside).join(shifts, [shard, "_bucket"])
        .withColumn(name, F.col("_shift") + F.col("_place") - 1).drop("_bucket", "_shift", "_place")
    )


def assign_shards(
    docs: DataFrame, tree: Sequence[Shard], grown: Sequence[Shard] | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: id, size in bytes plus 1, checksum of the text, shard and slot.

    ``grown_shard`` is the shard under a second tree. Other columns of ``docs`` are not carried, whatever
    their names. Null text: size 1, checksum 0. A null or repeated id is placed like any other; repeated rows get
    slots of their own. An empty table gives an empty result. DataFrame functions only.
    """
    key = F.col(doc_id)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    checksum = F.crc32(F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")))
    rows = docs.select(
        key.alias("doc_id"), size.alias("size"), checksum.alias("text_crc32"), place(key, tree).alias("shard"),
        (place(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_spread"),
    )
    placed = number_slots(stored(rows, "shards"), "shard", ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
