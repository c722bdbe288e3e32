"""Compiling a corpus: from raw documents to a masked, enriched and split table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.functions import lexicon as lx
from penprint.functions.text import clean
from penprint.operators import curate, split, stats
from penprint.operators.features import LanguageProfiles, detect_language
from penprint.session import durable
from penprint.spec import Columns

PROFILING = "__split_author_profiling"
ATTRIBUTION = "__split_author_attribution"


@dataclass(frozen=True)
class CorpusSettings:
    """Limits and the groupings of the author traits."""

    minimum: int = lx.MIN_DOCUMENTS
    maximum: int = lx.MAX_DOCUMENTS
    months: Sequence[int] = tuple(range(1, 13))
    train_authors: int = lx.TRAIN_AUTHORS
    sampled: int = lx.SAMPLED_PER_AUTHOR
    seed: int = 0
    language: str = "es"
    mask_prefix: str = "@user"
    trait_names: Mapping[str, str] = field(default_factory=lambda: {"gender": "gender", "age": "age_range", "linked_to": "affiliation"})
    left: Sequence[str] = ()
    groups: Mapping[str, Sequence[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class CompiledCorpus:
    corpus: DataFrame
    masks: DataFrame
    by_author: DataFrame
    by_month: DataFrame
    by_language: DataFrame


def compile_corpus(
    documents: DataFrame, profiles: LanguageProfiles | None, topics: DataFrame, traits: DataFrame, trait_key: str,
    columns: Columns = Columns(), settings: CorpusSettings = CorpusSettings(), language: str | None = None,
) -> CompiledCorpus:
    """Filter, select, mask, enrich and split.

    The language of a document is what its column ``language`` says, where that is given, and else what the profiles say of its cleaned text.

    Two stages are stored. The cleaned texts are read for scoring the language, for
    counting authors and for selecting. The selection holds at most some hundreds of
    documents per author; masks, traits and both splits are built from it.
    """
    c, s = columns, settings
    kept = durable(clean(curate.drop_syndicated(documents, c.text), c.text, into="text_clean", language=s.language))
    if language is None:
        spoken = detect_language(kept, c.doc_id, "text_clean", profiles).drop("confidence")
    else:
        spoken = kept.withColumnRenamed(language, "language")
    enough = curate.min_documents(curate.keep_language(spoken, "language", s.language), c.author, s.minimum)
    flagged = curate.flag_topic(enough, c.text, topics)
    selected = durable(curate.relevant_sample(
        flagged, c.author, c.created_at, "is_relevant", "text_clean", c.doc_id, maximum=s.maximum, months=s.months))

    masks = curate.number_authors(selected, c.author, s.seed, s.mask_prefix)
    masked = curate.mask_author(curate.mask_handles(selected, c.doc_id, c.text, masks, c.author), c.author, masks, c.label)
    enriched = curate.attach_author_traits(masked, traits, c.author, trait_key, s.trait_names)
    if "age_range" in enriched.columns:
        enriched = enriched.withColumn("age_range", curate.bin_range(F.col("age_range")))
    if "affiliation" in enriched.columns:
        enriched = enriched.withColumn("ideological_binary", curate.map_membership(F.col("affiliation"), s.left)).withColumn(
            "ideological_multiclass", curate.map_groups(F.col("affiliation"), s.groups))

    known = selected.join(traits.select(F.col(trait_key).alias(c.author)), c.author, "left_semi")
    order = [c.created_at, c.doc_id]
    profiling = split.author_disjoint_split(known, c.author, order, s.train_authors, s.seed, PROFILING).select(c.doc_id, PROFILING)
    attribution = split.author_attribution_split(
        known, c.author, c.doc_id, order, s.train_authors, s.sampled, s.seed, ATTRIBUTION).select(c.doc_id, ATTRIBUTION)
    both = enriched.join(profiling, c.doc_id, "left").join(attribution, c.doc_id, "left")
    published = [
        n for n in (c.doc_id, c.created_at, c.author, c.label, "gender", "age_range", "affiliation", "ideological_binary",
                    "ideological_multiclass", PROFILING, ATTRIBUTION, c.text) if n in both.columns
    ]
    corpus = curate.project_final(both, published, [PROFILING, ATTRIBUTION])
    return CompiledCorpus(
        curate.shuffle_documents(corpus, c.doc_id, s.seed), masks,
        stats.docs_per_author(documents, c.author), stats.docs_per_author_month(documents, c.author, c.created_at),
        stats.docs_per_author_language(spoken, c.author, "language"),
    )
