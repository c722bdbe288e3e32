"""Cleaning operators: each takes a text column and returns a text column.

All are JVM expressions, so a list of them folds into one projection and works
on batch and streaming frames alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions import lexicon as lx

Cleaner = Callable[[Column], Column]


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, lx.URL, "")


def remove_mentions(text: Column, placeholder: str = lx.USER_PLACEHOLDER, collapse: bool = False) -> Column:
    """Drop the handles a text opens with and replace the others.

    Runs of the literal ``@USER`` become one placeholder; ``collapse`` also
    merges runs of the placeholder itself.
    """
    kept = _literal(placeholder)
    text = F.regexp_replace(text, lx.LEADING_MENTIONS, "")
    text = F.regexp_replace(text, lx.MENTION, kept)
    text = F.regexp_replace(text, lx.REPEATED_PLACEHOLDER, kept + " ")
    if collapse:
        text = F.regexp_replace(text, "(?:" + _quoted(placeholder) + " ){2,}", kept + " ")
    return text


def expand_hashtags(text: Column) -> Column:
    """Replace each hashtag by its words, split where the case or a number says so."""

    def apply(text: Column) -> Column:
        tags = F.regexp_extract_all(text, F.lit(lx.HASHTAG), 1)
        words = F.transform(tags, lambda tag: F.regexp_replace(F.regexp_replace(tag, lx.CAMEL_PART, "$0 "), " $", ""))
        between = F.split(text, lx.HASHTAG, -1)
        woven = F.zip_with(between, words, lambda gap, word: F.concat(gap, F.coalesce(word, F.lit(""))))
        return F.when(F.contains(text, F.lit("#")), F.array_join(woven, "")).otherwise(text)

    return _once(text, apply)


def remove_hashtags(text: Column, template: str = lx.HASHTAG_TEMPLATE) -> Column:
    """Tag each hashtag; ``$1`` in the template stands for its word."""
    return F.regexp_replace(text, lx.HASHTAG, template)


def remove_percentages(text: Column, placeholder: str = lx.PERCENTAGE_PLACEHOLDER) -> Column:
    return F.regexp_replace(text, lx.PERCENTAGE, _literal(placeholder))


def remove_digits(text: Column, placeholder: str = lx.NUMBER_PLACEHOLDER) -> Column:
    return F.regexp_replace(text, lx.NUMBER, _literal(placeholder))


def remove_whitespaces(text: Column) -> Column:
    """One blank between words, sentence breaks for loose dots and dashes."""
    text = F.regexp_replace(text, lx.BLANKS, " ")
    text = F.regexp_replace(text, lx.ORPHAN_DOTS, ". ")
    # Twice: dashes that share a blank do not both match in one pass.
    text = F.regexp_replace(text, lx.DASH, ". ")
    text = F.regexp_replace(text, lx.DASH, ". ")
    return F.regexp_replace(text, lx.ORPHAN_MARKS, "$1 ")


def remove_emojis(text: Column) -> Column:
    return F.regexp_replace(text, lx.EMOJI, "")


def remove_quotations(text: Column) -> Column:
    return F.translate(text, lx.QUOTES, "")


def remove_elongations(text: Column, accent_vowels: bool = True) -> Column:
    """Shorten laughs, runs of marks and any character repeated three times or more.

    With ``accent_vowels`` a doubled vowel becomes its accented form and keeps
    its case, so ``leer`` turns into ``lér``.
    """
    text = F.regexp_replace(text, lx.LAUGH, lx.LAUGH_WORD)
    text = F.regexp_replace(text, lx.MARK_RUN, "$1")
    text = F.regexp_replace(text, lx.ELONGATION, "$1")
    if not accent_vowels:
        return text
    pairs = [(low, low.upper()) for low in lx.VOWELS]

    def capitals(text: Column) -> Column:
        def one(text: Column, pair: tuple[str, str]) -> Column:
            low, up = pair
            run = f"(?<![{low}{up}])[{up}](?:[{up}]+|[{low}]+)(?![{low}{up}])"
            return F.regexp_replace(text, run, up[1])

        # Few texts double a vowel after a capital one; the others skip five passes.
        gate = "|".join(f"[{up}][{low}{up}]" for low, up in pairs)
        return F.when(text.rlike(gate), reduce(one, pairs, text)).otherwise(text)

    text = _once(text, capitals)
    return reduce(lambda t, pair: F.regexp_replace(t, f"[{pair[0]}{pair[1]}]{{2,}}", pair[0][1]), pairs, text)


def to_lower(text: Column) -> Column:
    return F.lower(text)


def remove_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, lx.PUNCTUATION, "")


def expand_gender(text: Column) -> Column:
    return F.regexp_replace(text, lx.GENDER, "$1os y $1as")


def term_pattern(key: str) -> str:
    """Whole-word pattern of a term; a term ending in an escaped plus must be
    followed by that plus (or a backspace)."""
    if key.endswith(r"\+"):
        return rf"(?iuU)\b{key[:-2]}[\x08+]"
    return rf"(?iuU)\b{key}\b"


def expand_terms(text: Column, terms: Mapping[str, str]) -> Column:
    """Replace terms in the order given; later terms see earlier replacements.

    Neighbouring plain words are replaced together: a whole word can equal only
    one of them, and what later words of the run do to a replacement is worked
    out beforehand. Neighbouring patterns run one after another. A run starts
    with one combined test, because most texts contain none of its terms; the
    first term to fire must match the text as the run got it, so skipping is exact.
    """
    runs = [(plain, dict(run)) for plain, run in groupby(terms.items(), lambda kv: re.fullmatch(r"\w+", kv[0]) is not None)]
    return reduce(lambda t, run: _once(t, _words_run(run[1]) if run[0] else _patterns_run(run[1])), runs, text)


def _words_run(terms: Mapping[str, str]) -> Cleaner:
    items, written = list(terms.items()), {}
    for i, (key, value) in enumerate(items):
        for later, replacement in items[i + 1 :]:
            value = re.sub(rf"(?i)\b{later}\b", replacement, value)
        written.setdefault(key.lower(), value)
    keys = F.array(*[F.lit(key) for key in written])

    def apply(text: Column) -> Column:
        lookup = F.create_map(*[F.lit(v) for pair in written.items() for v in pair])
        said = F.zip_with(
            F.split(text, lx.WORD_RUN, -1), F.regexp_extract_all(text, F.lit(lx.WORD_RUN), 0),
            lambda gap, hit: F.concat(gap, F.coalesce(F.element_at(lookup, F.lower(hit)), hit, F.lit(""))),
        )
        present = F.arrays_overlap(F.split(F.lower(text), lx.BETWEEN_WORDS), keys)
        return F.when(present, F.array_join(said, "")).otherwise(text)

    return apply


def _patterns_run(terms: Mapping[str, str]) -> Cleaner:
    def apply(text: Column) -> Column:
        chain = reduce(lambda t, kv: F.regexp_replace(t, term_pattern(kv[0]), kv[1]), terms.items(), text)
        if len(terms) == 1:
            return chain
        gate = "|".join(f"(?:{term_pattern(key)})" for key in terms)
        return F.when(text.rlike(gate), chain).otherwise(text)

    return apply


def _once(value: Column, step: Cleaner) -> Column:
    """Apply a step that reads its input several times to a value computed once."""
    return F.get(F.transform(F.array(value), step), F.lit(0))


def replace_substring(text: Column, substring: str, replacement: str = "") -> Column:
    return F.replace(text, F.lit(substring), F.lit(replacement))


def strip(text: Column, characters: str = lx.STRIP_CHARACTERS) -> Column:
    return F.btrim(text, F.lit(characters))


def trim_ending_ellipsis(text: Column) -> Column:
    return F.rtrim(text, F.lit(lx.ELLIPSIS))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, lx.BLANKS), lambda word: word != ""))


def expand_chat_terms(text: Column) -> Column:
    """Chat terms, then short dates. No written-out date is a short one again, so
    all months are replaced in one pass."""

    def dates(text: Column) -> Column:
        months = F.create_map(*[F.lit(v) for month in lx.MONTHS for v in (month[:3], month)])
        hits = F.regexp_extract_all(text, F.lit(lx.SHORT_DATE), 0)
        said = F.zip_with(F.split(text, lx.SHORT_DATE, -1), hits, lambda gap, hit: F.concat(gap, F.coalesce(
            F.concat(F.substring(hit, 1, 2), F.lit(" de "), F.element_at(months, F.lower(F.right(hit, F.lit(3))))), F.lit(""))))
        return F.when(text.rlike(lx.SHORT_DATE), F.array_join(said, "")).otherwise(text)

    return _once(expand_terms(text, lx.CHAT_TERMS), dates)


def expand_acronyms(text: Column) -> Column:
    return expand_terms(text, lx.ACRONYMS)


SPANISH_TERMS: tuple[Cleaner, ...] = (expand_chat_terms, expand_acronyms)
DEFAULT_STEPS: tuple[Cleaner, ...] = (
    remove_urls,
    remove_hashtags,
    remove_mentions,
    remove_digits,
    remove_whitespaces,
    remove_elongations,
    remove_emojis,
    remove_quotations,
    remove_punctuation,
    remove_whitespaces,
    strip,
    trim_ending_ellipsis,
)


def clean(
    df: DataFrame,
    column: str,
    pipeline: Sequence[Cleaner] | None = None,
    into: str | None = None,
    language: str = "es",
) -> DataFrame:
    """Run a list of cleaners over a column, by default the standard list.

    Spanish text first has its chat terms and acronyms written out; a custom
    list is applied exactly as given.
    """
    if pipeline is None:
        pipeline = (*SPANISH_TERMS, *DEFAULT_STEPS) if language == "es" else DEFAULT_STEPS
    return df.withColumn(into or column, reduce(lambda text, step: step(text), pipeline, F.col(column)))


def add_clean_columns(
    df: DataFrame, text: str, language: str = "es", clean_name: str = "text_clean", lower_name: str = "text_clean_lowercase"
) -> DataFrame:
    """Add the cleaned text and its lower-case form next to the raw text."""
    return clean(df, text, into=clean_name, language=language).withColumn(lower_name, F.lower(clean_name))


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"
