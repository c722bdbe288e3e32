"""Mentions of topics, by an index of the topics' rarest short strings.

A topic is found anywhere in a text, inside words too, and each blank in it is optional. So a text that mentions it holds, once blanks
are dropped and case is folded, every short string of the topic. Each topic stands in the index under the one of its strings that
the fewest topics have; texts meet it there, and its pattern is tried on those texts alone. Topics that are patterns rather than
plain words have no such string, and are tried on every text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.session import stored

GRAM = 6  # characters of a string of the index; a shorter topic is one as a whole
PATTERN = r"[\\^$.|?*+()\[\]{}]"  # what makes a topic a pattern


def folded(text: Column) -> Column:
    """Without blanks, and with letters that differ in case alone made equal. Dots over a small i, and final sigmas, go with the case."""
    plain = F.regexp_replace(text, r"(?U)\s+", "")
    return F.translate(F.lower(F.upper(plain)), "ς̇", "σ")


def strings(text: Column, size: int) -> Column:
    """The distinct strings of ``size`` characters of a text, in one sweep over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def as_pattern(topic: Column) -> Column:
    """The case-blind pattern of a topic, as text; a blank in it is optional."""
    return F.concat(F.lit("(?iu)"), F.replace(topic, F.lit(" "), F.lit(r"\s?")))


def topic_cells(topics: DataFrame) -> DataFrame:
    """``topic``: the distinct non-null cells of all columns of a topic table."""
    cells = [topics.select(F.col(f"`{name}`").cast("string").alias("topic")) for name in topics.columns]
    return reduce(DataFrame.unionAll, cells).where("topic IS NOT NULL").distinct()


def topic_index(cells: DataFrame) -> DataFrame:
    """``string``, ``size`` and ``topic`` of every topic of plain words: where it stands in the index."""
    plain = cells.where(~F.col("topic").rlike(PATTERN)).withColumn("_folded", folded(F.col("topic"))).where("_folded != ''")
    size = F.least(F.char_length("_folded"), F.lit(GRAM))
    cut = F.when(size < GRAM, F.array("_folded")).otherwise(strings(F.col("_folded"), GRAM))
    each = plain.select("topic", size.alias("size"), F.explode(cut).alias("string"))
    common = each.groupBy("string").agg(F.count("*").alias("n"))
    return each.join(common, "string").groupBy("topic").agg(F.min_by(F.struct("string", "size"), F.struct("n", "string")).alias("at")).select("at.*", "topic")


def flag_topic(df: DataFrame, text: str, topics: DataFrame, name: str = "is_relevant") -> DataFrame:
    """Flag texts that mention any non-null cell of ``topics``; a null text has a null flag.

    Cells are pattern text, whatever their number: nothing of the table reaches the driver, and the plan does not grow with it. Texts meet the index by their strings;
    only digests of texts and topics are paired, and a text is looked at again for the topics that it met. Blank cells, and cells that are patterns, are kept in
    one array that every text tries.
    """
    cells = stored(topic_cells(topics))
    index = stored(topic_index(cells))
    body = F.col(f"`{text}`")
    digest = F.sha2(F.encode(body, "UTF-8"), 256)
    texts = df.where(body.isNotNull()).select(body.alias("_text"), digest.alias("_digest"))
    # The lengths of strings are 1 to GRAM; only those that some topic has are cut from the texts.
    sizes = sorted(row["size"] for row in index.select("size").distinct().collect())
    cut = F.concat(F.array().cast("array<string>"), *[strings(F.col("_folded"), size) for size in sizes])
    met = (
        texts.select("_digest", folded(F.col("_text")).alias("_folded")).select("_digest", F.explode(cut).alias("string"))
        .join(index.select("string", "topic"), "string").select("_digest", "topic").distinct()
    )
    found = texts.join(met, "_digest").where(F.regexp_like("_text", as_pattern(F.col("topic")))).select("_digest").distinct()
    others = cells.where(F.col("topic").rlike(PATTERN) | (folded(F.col("topic")) == "")).select(as_pattern(F.col("topic")).alias("topic"))
    patterns = others.agg(F.collect_list("topic")).scalar()
    flagged = df.withColumn("_digest", digest).withColumn("_patterns", patterns).join(found.withColumn("_met", F.lit(True)), "_digest", "left")
    mentioned = F.coalesce("_met", F.lit(False)) | F.exists("_patterns", lambda p: F.regexp_like(body, p))
    return flagged.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.when(body.isNotNull(), mentioned).alias(name))
