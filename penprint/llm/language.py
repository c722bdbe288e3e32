"""Language identification by words first, then by ever shorter character n-grams.

A known word scores its log frequency in every language. An unseen word falls back to the longest
length of n-grams (of the word between boundary marks) of which the model knows any, and scores the mean log frequency of
those. The scores of all words of the whole text are added up; their softmax is the posterior.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import extended, small_batches, stored

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.string()), ("n", pa.int64())])
FLUSH = 400_000  # distinct counts a task holds before it passes them on
REMEMBERED = 200_000  # words whose place, and unseen ones whose score, a task keeps
SEED = 42  # of Spark's own xxhash64


def grams(word: str, size: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i:i + size] for i in range(len(marked) - size + 1)]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (size 0) and of n-grams per language, combined inside the task."""
    words: Counter = Counter()

    def emit() -> Iterator[pa.RecordBatch]:
        rows: Counter = Counter()
        for (lang, word), n in words.items():
            rows[lang, 0, word] += n
            for size in range(1, LONGEST + 1):
                for gram in grams(word, size):
                    rows[lang, size, gram] += n
        if rows:
            keys = list(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([k[2] for k in keys], pa.string()), pa.array(list(rows.values()), pa.int64())], schema=COUNTS)
        words.clear()

    for batch in small_batches(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words.update((lang, w) for w in WORD.findall(text.lower()))
        if len(words) > FLUSH:
            yield from emit()
    yield from emit()


def key_of(size: int, gram: str) -> int:
    """The hash under which the model knows a word (size 0) or n-gram: that of Spark's ``xxhash64``."""
    return xxhash.xxh64_intdigest(f"{size} {gram}", SEED)


@dataclass
class LanguageModel:
    """Log frequencies: a row of ``weights`` for each of the sorted ``keys`` of words and n-grams, one column per language."""

    languages: list[str]
    keys: np.ndarray
    weights: np.ndarray
    places: dict[str, int] = field(default_factory=dict, repr=False)
    scores: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def known(self, size: int, grams_: list[str]) -> np.ndarray:
        """Rows of those that the model knows, -1 for others."""
        wanted = np.array([key_of(size, g) for g in grams_], np.uint64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of each word, -1 if it is not known. The places of words are remembered."""
        get = self.places.get
        out = [get(w) for w in words]
        if None in out:
            new = list(dict.fromkeys(w for w, r in zip(words, out) if r is None))
            found = dict(zip(new, self.known(0, new).tolist()))
            if len(self.places) + len(found) <= REMEMBERED:
                self.places.update((w, r) for w, r in found.items() if len(w) < 64)
            out = [found[w] if r is None else r for w, r in zip(words, out)]
        return np.array(out, np.int64)

    def unseen(self, word: str) -> np.ndarray:
        found = self.scores.get(word)
        if found is None:
            found = np.zeros(len(self.languages))
            for size in range(LONGEST, 0, -1):
                rows = self.known(size, grams(word, size))
                if (rows >= 0).any():
                    found = self.weights[rows[rows >= 0]].mean(0)
                    break
            if len(self.scores) < REMEMBERED and len(word) < 64:
                self.scores[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not self.languages or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        hits = self.rows(words)
        total = self.weights[hits[hits >= 0]].sum(0)
        if (hits < 0).any():
            total = total + sum(self.unseen(w) for w, r in zip(words, hits.tolist()) if r < 0)
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = 16_384, seed: int = 7) -> LanguageModel:
    """Learn word and n-gram frequencies from labelled rows.

    The classifier is fitted on a bounded sample: about ``max_rows`` rows with a text and a label, chosen by a hash of the text. It keeps all words and n-grams
    of these rows, known by 64-bit hashes; the number of rows is its only bound.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    share = min(1.0, max_rows / max(1, rows.count()))
    picked = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
    counts = stored(
        rows.where(picked).mapInArrow(count_grams, "lang string, size int, gram string, n long")
        .groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
        .select("lang", "size", F.xxhash64(F.concat_ws(" ", F.col("size"), F.col("gram"))).alias("key"), "n"), "grams")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], np.empty(0, np.uint64), np.zeros((0, 0)))
    found = counts.select(F.array_position(F.lit(languages), F.col("lang")).cast("int").alias("lang"), "size", "key", "n").toArrow()
    column, size, key, n = (found[c].to_numpy() for c in ("lang", "size", "key", "n"))
    keys, first, row = np.unique(key.view(np.uint64), return_index=True, return_inverse=True)
    seen = np.full((len(keys), len(languages)), 0.5)
    seen[row, column - 1] += n
    for k in range(LONGEST + 1):  # words and n-grams of each length are a distribution of their own
        own = size[first] == k
        total = np.array([n[(size == k) & (column == i + 1)].sum() for i in range(len(languages))], float)
        seen[own] = np.log(seen[own] / (total + 0.5 * max(int(own.sum()), 1)))
    return LanguageModel(languages, keys, seen)


def _judged(docs: DataFrame, model: LanguageModel, text: str, carry: list[str]) -> DataFrame:
    """The ``carry`` columns of ``docs`` by their places, ``_lang`` and ``_score``. The text passes through Python once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent = carry if text in carry else [*carry, text]
    place = sent.index(text)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(sent)])
    names = rows.columns[:len(carry)]
    schema = extended(rows.select(*names).schema, "_lang string, _score double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in small_batches(batches):
            found = [known.predict(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*names, "_lang", "_score"])

    return rows.mapInArrow(predict, schema)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of ``docs`` (all, by default) with ``lang_pred`` and ``score`` (the posterior, 0 to 1) of every whole text.

    A null text, or one without letters, or an empty model gives ``und`` and 0. Only the text is looked at. Carried columns
    named ``lang_pred`` or ``score`` give way to the prediction. The model is broadcast; ``fit`` bounds its size.
    """
    carry = docs.columns if carry is None else carry
    kept = [F.col(f"_{i}").alias(c) for i, c in enumerate(carry) if c not in ("lang_pred", "score")]
    return _judged(docs, model, text, carry).select(*kept, F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known, with all their columns, whatever their names."""
    known = _judged(docs, model, text, docs.columns).where(F.col("_lang") != UNKNOWN)
    return known.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows kept apart for testing: one fold by the checksum of the id. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
