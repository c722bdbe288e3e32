"""Seeded orders, exact ranks and exact cuts that never gather a table in one task.

Random orders come from ``order_key``, a hash of the seed and the id, so they do
not depend on how rows are partitioned and can be recomputed anywhere. Because
the hash is uniform, its leading digits are buckets of equal size: a histogram
over them finds the key at any rank with two light passes over the id column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.session import durable, stored

BUCKET_DIGITS = 4
BUCKETS = 16**BUCKET_DIGITS
SLICES = 256
FREQUENT = 1000


def order_key(seed: int | str, *ids: str | Column) -> Column:
    """Hex hash of ``seed:id[:id…]``; sorting by it is a seeded shuffle."""
    parts = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_fraction(key: Column) -> Column:
    """Position of a hex key in [0, 1), rising with the key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(16**8))


def keys_at(keys: DataFrame, wanted: dict[object, Sequence[int]]) -> dict[object, list[str | None]]:
    """The keys found at given 0-based ranks, per series.

    ``keys`` has the columns ``series`` and ``key`` (a hex hash); ``wanted`` lists
    the ranks asked for in each series. A rank past the end gives ``None``.
    The driver sees one count per bucket (at most ``BUCKETS`` for each series)
    and one key per rank; the keys themselves are sorted only inside the
    few buckets a wanted rank falls into.
    """
    bucket = F.substring("key", 1, BUCKET_DIGITS)
    counts = keys.groupBy("series", bucket.alias("bucket")).count().toArrow().to_pandas()
    found: dict[object, list[str | None]] = {s: [None] * len(r) for s, r in wanted.items()}
    asked = []
    for series, part in counts.groupby("series"):
        part = part.sort_values("bucket")
        upto = part["count"].cumsum()
        for position, rank in enumerate(wanted.get(series, ())):
            inside = part[upto > rank]
            if len(inside):
                first = inside.iloc[0]
                before = int(upto[upto <= rank].max()) if (upto <= rank).any() else 0
                asked.append((series, first["bucket"], rank - before + 1, position))
    if not asked:
        return found
    spark = keys.sparkSession
    target = spark.createDataFrame(asked, f"series {keys.schema['series'].dataType.simpleString()}, "
                                   "bucket string, nth long, position int")
    inside = keys.withColumn("bucket", bucket).join(
        F.broadcast(target.select("series", "bucket").distinct()), ["series", "bucket"]
    )
    nth = F.row_number().over(Window.partitionBy("series", "bucket").orderBy("key"))
    rows = inside.withColumn("nth", nth.cast("long")).join(F.broadcast(target), ["series", "bucket", "nth"])
    for row in rows.select("series", "position", "key").collect():
        found[row["series"]][row["position"]] = row["key"]
    return found


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, spread: Column, name: str = "_place"
) -> DataFrame:
    """Rows ranked up to ``n`` in their group, with the rank in ``name``.

    Up to its own limit, a setting of the session, Spark itself drops rows ranked past ``n`` before the
    shuffle. Beyond, rows are first limited inside slices of their group, so that
    even a group holding a third of the table is ranked by many tasks;
    ``spread`` is a value that differs between rows, as the document id.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        slice_ = F.pmod(F.xxhash64(spread), F.lit(SLICES))
        inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = df.withColumn("_slice", slice_).withColumn(name, F.row_number().over(inside))
        df = df.where(F.col(name) <= n).drop("_slice", name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def split_join(df: DataFrame, table: DataFrame, keys: Sequence[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """Join a table with one row per key, so that rows of a frequent key are dealt over as many tasks as its share of all rows asks for.

    ``counts``, a stored table, has the keys and the ``count`` of their rows in ``df``. A key with more than one row in ``FREQUENT`` is
    frequent, so fewer than that many are, and their names are broadcast. Only rows of ``table`` with such keys are repeated, once for each slice; rows of ``df`` are sliced
    by the partition they are in. What follows can still combine or limit the rows of a key inside a task before they are brought together. Without
    frequent keys this is a plain join.
    """
    facts = counts.agg(F.sum("count").alias("total"), F.max("count").alias("most")).first()
    if not facts["most"] or facts["most"] * FREQUENT <= facts["total"]:
        return df.join(table, list(keys), how)
    tasks = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.col("count") / facts["total"]
    frequent = F.broadcast(counts.where(share > 1 / FREQUENT).select(*keys, F.ceil(share * tasks).cast("int").alias("_slices")))
    slices = F.coalesce("_slices", F.lit(1))
    each = table.join(frequent, list(keys), "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices")
    sliced = df.join(frequent, list(keys), "left").withColumn("_slice", F.pmod(F.spark_partition_id(), slices)).drop("_slices")
    return sliced.join(each, [*keys, "_slice"], how).drop("_slice")


def hash_rank(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """Add the 1-based rank of each row by a hex hash column, without a global sort.

    Rows are ranked inside their bucket, then shifted by the rows in lower
    buckets. The bucket table has at most ``BUCKETS`` rows.
    """
    bucket = F.substring(key, 1, BUCKET_DIGITS)
    lower = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        df.groupBy(bucket.alias("_bucket")).count()
        .select("_bucket", F.coalesce(F.sum("count").over(lower), F.lit(0)).alias("_shift"))
    )
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        df.withColumn("_bucket", bucket)
        .withColumn("_local", local)
        .join(F.broadcast(shifts), "_bucket")
        .withColumn(name, F.col("_shift") + F.col("_local"))
        .drop("_bucket", "_shift", "_local")
    )


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Add the 1-based rank of each row in any total order.

    Rows are range-partitioned and sorted; a row's rank is its place in its
    partition plus the rows of the partitions before it. The sorted rows are
    stored first, because range bounds are sampled anew by every job and the
    counts must describe the same partitions as the places. The table of
    offsets has one row per partition.
    """
    columns = df.columns
    placed = durable(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_place", 33)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part")).count()
        .select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_place") - F.shiftleft("_part", 33) + 1)
        .select(*columns, name)
    )


def characters_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], length: str, name: str = "_before") -> DataFrame:
    """Add the sum of ``length`` over the rows before each row in the order of its group.

    Rows are sorted in ranges and stored, since range bounds are sampled anew by every job. Sums run inside
    a group's share of a range and are shifted by its shares of earlier ranges, so a group that holds a third of the rows is
    summed by many tasks. Null keys are groups.
    """
    columns = df.columns
    ranged = durable(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()))
    inside = Window.partitionBy(*keys, "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shares = ranged.groupBy(*keys, "_range").agg(F.sum(length).alias("_sum"))
    shifts = shares.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    summed = ranged.withColumn("_sum", F.coalesce(F.sum(length).over(inside), F.lit(0)))
    return summed.join(shifts, [F.col("_range") == F.col("_r"), *same]).withColumn(name, F.col("_sum") + F.col("_shift")).select(*columns, name)


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    exact: bool = True,
    accuracy: int = 10000,
) -> DataFrame:
    """Interpolated quantiles per group, one row per group and probability.

    Result columns: the keys, ``probability``, ``quantile``. The approximate
    form is one mergeable sketch per group. The exact form uses the sketch only
    to bracket each quantile: it then counts what lies below the bracket and
    ranks the distinct values inside it, a share of about ``6 / accuracy`` of
    the group, so no task ever holds a whole group.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if not exact:
        sketch = F.percentile_approx("_v", [float(p) for p in probabilities], accuracy)
        return (
            rows.groupBy(*keys).agg(sketch.alias("_q"))
            .select(*keys, F.posexplode("_q").alias("_i", "quantile"))
            .select(*keys, F.element_at(_doubles(probabilities), F.col("_i") + 1).alias("probability"), "quantile")
        )
    # The sketch may be off by 1 / accuracy of the ranks, and its rank by one row, which is
    # less than that share in a group larger than ``accuracy``. Smaller groups are taken whole.
    margin = 3.0 / accuracy
    small = F.col("_n") <= accuracy
    low = [max(p - margin, 0.0) for p in probabilities]
    high = [min(p + margin, 1.0) for p in probabilities]
    brackets = (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
             F.percentile_approx("_v", low + high, accuracy).alias("_b"))
        .select(
            *keys, "_n", "_min", "_max", "_b",
            F.posexplode(_doubles(probabilities)).alias("_i", "probability"),
        )
        .select(
            *keys, "probability",
            (F.col("probability") * (F.col("_n") - 1)).alias("_pos"),
            F.when(small | (F.col("probability") <= margin), F.col("_min"))
            .otherwise(F.element_at("_b", F.col("_i") + 1)).alias("_lo"),
            F.when(small | (F.col("probability") >= 1 - margin), F.col("_max"))
            .otherwise(F.element_at("_b", F.col("_i") + 1 + len(low))).alias("_hi"),
        )
    )
    if keys:  # a few numbers for each group; stored, so that Spark broadcasts them if they are small and shuffles no row
        brackets = stored(brackets)
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    matched = rows.join(brackets, keys) if keys else _with_all(rows, brackets)
    # One partial aggregate: rows under a bracket collapse into a single count.
    counted = (
        matched.where(F.col("_v") <= F.col("_hi"))
        .groupBy(*keys, "probability", "_pos", F.when(inside, F.col("_v")).alias("_v"))
        .count()
    )
    upto = Window.partitionBy(*keys, "probability").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_upto", F.sum("count").over(upto))
    lower = F.min(F.when(F.col("_v").isNotNull() & (F.col("_upto") > F.floor("_pos")), F.col("_v")))
    upper = F.min(F.when(F.col("_v").isNotNull() & (F.col("_upto") > F.ceil("_pos")), F.col("_v")))
    return (
        ranked.groupBy(*keys, "probability", "_pos")
        .agg(lower.alias("_x"), upper.alias("_y"))
        .select(*keys, "probability",
                (F.col("_x") + (F.col("_pos") - F.floor("_pos")) * (F.col("_y") - F.col("_x"))).alias("quantile"))
    )


def _doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _with_all(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """Pair an ungrouped table with its few brackets, carried as one scalar array."""
    packed = brackets.agg(F.collect_list(F.struct("probability", "_pos", "_lo", "_hi")).alias("_all"))
    return rows.withColumn("_one", F.explode(packed.scalar())).select("_v", "_one.*")
