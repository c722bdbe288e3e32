"""Corpus curation: filters, bins and groups, joins, masking and balanced selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.functions import lexicon as lx
from penprint.functions.order import first_per_group, hash_rank, order_key, split_join
from penprint.functions.text import word_count
from penprint.operators.topics import flag_topic
from penprint.session import stored
from penprint.spec import SPLIT, SPLITS, TaskSpec


# --- Projections, filters, predicates ----------------------------------------
def task_view(df: DataFrame, spec: TaskSpec, corpus_split: str | None = None) -> DataFrame:
    """Point the label and split columns at those of a task."""
    df = df.withColumn(spec.columns.label, F.col(spec.label))
    split = spec.split or corpus_split
    return df.withColumn(spec.columns.split, F.col(split)) if split in df.columns else df


def select_split(df: DataFrame, key: str, split: str = SPLIT) -> DataFrame:
    if key in ("all", "full"):
        return df
    if split not in df.columns:
        raise ValueError(f"no split column {split!r} in {df.columns}")
    return df.where(F.col(split) == key)


def drop_unlabelled(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull())


def drop_unsplit(df: DataFrame, split: str = SPLIT) -> DataFrame:
    return df.where(F.col(split).isin(*SPLITS))


def drop_syndicated(df: DataFrame, text: str) -> DataFrame:
    """Drop texts passed on from media: a closing "via @name", a bar, or a live tag."""
    return df.where(~F.col(text).rlike(lx.SYNDICATED))


def keep_language(df: DataFrame, language_column: str, language: str = "es") -> DataFrame:
    """Keep one language and drop the column; an unknown language is dropped too."""
    return df.where(F.col(language_column) == language).drop(language_column)


def min_documents(df: DataFrame, author: str, n: int = lx.MIN_DOCUMENTS) -> DataFrame:
    """Keep authors with at least ``n`` documents.

    Counting combines on the map side; the join sends author names around, or deals the documents of frequent authors in slices
    where there are too many names, so no task gets all documents of an author.
    """
    counts = stored(df.groupBy(author).count().where(F.col("count") >= n))
    return split_join(df, counts.select(author), [author], counts, "left_semi")


def bin_range(
    value: Column, edges: Sequence[float] = lx.AGE_EDGES, labels: Sequence[str] = lx.AGE_LABELS, right: bool = True
) -> Column:
    """Name of the interval a number falls in, null outside; ``right`` closes intervals on the right."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = (value > low) & (value <= high) if right else (value >= low) & (value < high)
        out = F.when(inside, label).otherwise(out)
    return out


def map_membership(value: Column, members: Sequence, inside: str = "left", outside: str = "right") -> Column:
    """``inside`` for listed values; everything else, null included, is ``outside``."""
    return F.when(F.coalesce(value.isin(list(members)), F.lit(False)), inside).otherwise(outside)


def map_groups(value: Column, groups: Mapping[str, Sequence]) -> Column:
    """Name of the last group that lists the value, null when none does."""
    out = F.lit(None).cast("string")
    for name, members in groups.items():
        out = F.when(value.isin(list(members)), name).otherwise(out)
    return out


def normalise_types(df: DataFrame, texts: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Null texts become empty, categories become strings; absent columns are skipped."""
    changed = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts if c in df.columns}
    changed |= {c: F.col(c).cast("string") for c in categories if c in df.columns}
    return df.withColumns(changed) if changed else df


def one_hot(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """One 0/1 column per value, named ``column_value``."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in values})


def multi_hot(df: DataFrame, label: str, labels: Sequence[str], separator: str = lx.MULTI_LABEL_SEPARATOR) -> DataFrame:
    """One 0/1 column per label of a separated list."""
    parts = F.split(F.col(label), separator)
    return df.withColumns({f"{label}_{v}": F.coalesce(F.array_contains(parts, v).cast("int"), F.lit(0)) for v in labels})


def columns_by_category(df: DataFrame, category: str, keys: Sequence[str] = ()) -> DataFrame:
    """The columns named ``category-…``, after the key columns."""
    return df.select(*keys, *[F.col(f"`{c}`") for c in df.columns if c.startswith(category + "-")])


def project_final(df: DataFrame, columns: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """Drop rows that belong to no split and keep the published columns in order."""
    return df.where(reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in splits])).select(*columns)


# --- Joins ----------------------------------------------------------------------
def attach_author_traits(df: DataFrame, traits: DataFrame, author: str, key: str, names: Mapping[str, str]) -> DataFrame:
    """Inner join author traits, renaming them; authors without traits vanish."""
    side = traits.select(F.col(key).alias(author), *[F.col(old).alias(new) for old, new in names.items()])
    return df.join(side, author)


def relabel(df: DataFrame, labels: DataFrame, author: str, columns: Sequence[str]) -> DataFrame:
    """Replace label columns by those of a corrected author table."""
    return df.drop(*columns).join(labels.select(author, *columns), author)


def semi_join(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def align_features(split_df: DataFrame, features: DataFrame, doc_id: str) -> DataFrame:
    """Features of the documents of a split; a document without features keeps a null.

    ``missing_features`` counts those.
    """
    return split_df.join(features, doc_id, "left")


def missing_features(aligned: DataFrame, features: str) -> DataFrame:
    return aligned.agg(F.count("*").alias("documents"), F.count_if(F.col(features).isNull()).alias("missing"))


# --- Selection ------------------------------------------------------------------
def balanced_month_sample(
    df: DataFrame, author: str, ts: str, relevant: Column, size: Column, position: Sequence[str],
    maximum: int = lx.MAX_DOCUMENTS, months: Sequence[int] = tuple(range(1, 13)),
) -> DataFrame:
    """Per author, take one document of each month in turn, best first, until ``maximum`` are held.

    Best means relevant first, then largest ``size``, then ``position``. A round
    that has begun is completed, so an author may exceed the maximum by up to
    one document per other month.

    A document ranked r in its month has at least r - 1 documents taken before
    it, so ranks above ``maximum`` can be dropped at once. Spark applies that
    limit before the shuffle, and each author's window holds at most
    ``maximum`` rows for each month however many documents the author wrote.
    """
    month = F.month(ts)
    earlier = Window.partitionBy(author).orderBy("_rank").rangeBetween(Window.unboundedPreceding, -1)
    measured = df.withColumns({"_month": month, "_relevant": relevant, "_size": size}).where(F.col("_month").isin(list(months)))
    best_first = [F.col("_relevant").desc(), F.col("_size").desc(), *position]
    return (
        first_per_group(measured, [author, "_month"], best_first, maximum, F.col(position[-1]), "_rank")
        .withColumn("_before", F.count("*").over(earlier))
        .where(F.col("_before") < maximum)
        .drop("_month", "_relevant", "_size", "_rank", "_before")
    )


def relevant_sample(df: DataFrame, author: str, ts: str, flag: str, text: str, doc_id: str, **kwargs) -> DataFrame:
    """``balanced_month_sample`` with topic flag and word count as the measures."""
    return balanced_month_sample(df, author, ts, F.col(flag).cast("int"), word_count(F.col(text)), [doc_id], **kwargs)


# --- Masking ---------------------------------------------------------------------
def number_authors(df: DataFrame, author: str, seed: int = 0, prefix: str = "@user") -> DataFrame:
    """Authors in a seeded random order with their masks: columns author, ``mask``."""
    authors = df.select(author).distinct().withColumn("_key", order_key(seed, author))
    ranked = hash_rank(authors, "_key", "_number")
    return ranked.select(author, F.concat(F.lit(prefix), F.col("_number").cast("string")).alias("mask"))


def mask_handles(df: DataFrame, doc_id: str, text: str, masks: DataFrame, account: str, mask: str = "mask") -> DataFrame:
    """Replace ``@account`` by its mask in every text, whatever the case, whole handles only.

    Only ids and handles travel to the mask table, one row per document and
    distinct handle; texts without a handle are not shuffled at all.
    """
    columns = df.columns
    handles = F.regexp_extract_all(F.col(text), F.lit(lx.HANDLE), 1)
    mentioned = F.contains(F.col(text), F.lit("@"))
    plain = df.where(~F.coalesce(mentioned, F.lit(False)))
    tagged = df.where(mentioned).withColumn("_handles", handles)
    # Accounts that differ only in case share the smallest of their masks, in every run.
    # Stored, so that mentions of a frequent handle are a skewed key between two plain shuffles, which Spark splits.
    lookup = stored(masks.groupBy(F.lower(account).alias("_handle")).agg(F.min(mask).alias("_mask")))
    found = (
        tagged.select(doc_id, F.explode(F.array_distinct(F.transform("_handles", lambda h: F.lower(h)))).alias("_handle")).join(lookup, "_handle")
        .groupBy(doc_id)
        .agg(F.map_from_entries(F.collect_list(F.struct("_handle", "_mask"))).alias("_masks"))
    )
    written = F.transform("_handles", lambda h: F.coalesce(F.element_at("_masks", F.lower(h)), F.concat(F.lit("@"), h)))
    between = F.split(F.col(text), lx.HANDLE, -1)
    woven = F.array_join(F.zip_with(between, written, lambda gap, h: F.concat(gap, F.coalesce(h, F.lit("")))), "")
    masked = (
        tagged.join(found, doc_id, "left")
        .withColumn(text, F.when(F.col("_masks").isNull(), F.col(text)).otherwise(woven))
    )
    return plain.unionByName(masked.select(*columns))


def mask_author(df: DataFrame, author: str, masks: DataFrame, into: str = "label", mask: str = "mask") -> DataFrame:
    """Write each author's mask into a column."""
    return df.drop(into).join(masks.select(author, F.col(mask).alias(into)), author)


# --- Order ------------------------------------------------------------------------
def sort_by_author(df: DataFrame, author: str, ts: str, doc_id: str) -> DataFrame:
    return df.orderBy(author, ts, doc_id)


def shuffle_documents(df: DataFrame, doc_id: str, seed: int = 0) -> DataFrame:
    """Documents in a seeded random order, the same whatever the partitioning."""
    return df.orderBy(order_key(seed, doc_id), doc_id)
