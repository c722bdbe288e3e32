"""Tokens and n-grams of a text, and their counts inside the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions import lexicon as lx


def words(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(lx.WORD), 0)


def characters(text: Column) -> Column:
    """Lower-case text whose characters are tokens, runs of two or more blanks taken as one blank."""
    return F.regexp_replace(F.lower(text), r"(?U)\s\s+", " ")


def vocabulary_tokens(text: Column) -> Column:
    """Lower-case pieces between blanks, listed punctuation read as blanks."""
    between = "[" + "".join("\\" + mark for mark in " " + lx.TOKEN_FILTER) + "]+"
    return F.array_remove(F.split(F.lower(text), between), "")


def term_counts(df: DataFrame, keys: Sequence[str], array: str = "_grams") -> DataFrame:
    """One row per row and distinct term: the keys, ``term`` and ``tf``.

    A row's terms are sorted and counted as runs inside the row, so counting per
    document needs no shuffle and only distinct terms leave the row.
    """
    place = F.col("_starts")
    starts = F.when(F.size("_sorted") > 0, F.filter(
        F.sequence(F.lit(0), F.size("_sorted") - 1),
        lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)),
    ))
    runs = F.transform(
        place,
        lambda start, k: F.struct(
            F.get("_sorted", start).alias("term"),
            (F.coalesce(F.get(place, k + 1), F.size("_sorted")) - start).cast("long").alias("tf"),
        ),
    )
    return (
        df.select(*keys, F.sort_array(array).alias("_sorted"))
        .select(*keys, "_sorted", starts.alias("_starts"))
        .select(*keys, F.explode(runs).alias("_run"))
        .select(*keys, "_run.term", "_run.tf")
    )
