"""N-grams counted over whole numbers, against plain Python."""

from collections import Counter

import pyarrow as pa
import pytest

from penprint.functions import grams
from penprint.operators import features

TEXTS = ["", "a", "abcabcab", "añb\0añb\0", "x \U0001F600\U0001F600 y", "abc", "the the cat"]


def plain(tokens, n, separator):
    tokens = tokens or ([""] if separator == "" else [])
    return Counter(separator.join(tokens[i:i + k]) for k in range(n[0], n[1] + 1) for i in range(len(tokens) - k + 1))


@pytest.mark.parametrize("room", [grams.ROOM, 1 << 12])
@pytest.mark.parametrize("kind, n", [("char", (1, 3)), ("char", (3, 5)), ("word", (1, 3))])
def test_totals_and_chosen_counts(monkeypatch, room, kind, n):
    """With little room for numbers, n-grams are numbered anew at every length."""
    monkeypatch.setattr(grams, "ROOM", room)
    tokens = [t.split() if kind == "word" else list(t) for t in TEXTS]
    column = pa.array(tokens, pa.list_(pa.string())) if kind == "word" else pa.array(TEXTS)
    each = [plain(t, n, " " if kind == "word" else "") for t in tokens]
    tf, df = Counter(), Counter()
    for batch in grams.totals(iter([pa.record_batch([column], names=["t"])]), kind, n):
        for term, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            tf[term] += a
            df[term] += b
    assert tf == sum(each, Counter()) and df == Counter(t for c in each for t in c)
    terms = [*list(tf)[::2], "zzz" if kind == "char" else "zzz cat"]
    keyed = pa.record_batch([pa.array(range(len(TEXTS))), column], names=["i", "t"])
    found = {}
    for batch in grams.chosen_counts(iter([keyed]), kind, terms, ("i", "p", "tf")):
        for i, p, c in zip(*(c.to_pylist() for c in batch.columns)):
            found[i] = {terms[a]: b for a, b in zip(p, c)}
    assert found == {i: own for i, c in enumerate(each) if (own := {t: v for t, v in c.items() if t in terms})}


@pytest.mark.parametrize("kind, n", [("char", (3, 5)), ("word", (1, 3))])
def test_longer_grams_of_rare_parts_are_not_counted(spark, kind, n):
    """The most used n-grams are the same with and without those that cannot be among them, which are left out."""
    texts = [f"the cat sat on the mat {i} the cat w{i} x{i % 7}" for i in range(60)]
    tokens = [[w for w in t.split() if len(w) > 1] if kind == "word" else list(t) for t in texts]
    each = [plain(t, n, " " if kind == "word" else "") for t in tokens]
    tf, df = sum(each, Counter()), Counter(t for c in each for t in c)
    best = sorted((t for t in tf if df[t] >= 2), key=lambda t: (-tf[t], t))[:5]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    fitted = (features.word_tfidf if kind == "word" else features.char_tfidf)(rows, "text", n, max_features=5)
    assert {r["term"]: (r["total"], r["df"]) for r in fitted.table.collect()} == {t: (tf[t], df[t]) for t in best}
    least = min(tf[t] for t in [t for t in sorted(tf, key=lambda t: -tf[t]) if df[t] >= 2 and len(t.split(" ") if kind == "word" else t) == n[0]][:5])
    parts = [t for t in tf if tf[t] >= least and len(t.split(" ") if kind == "word" else t) == n[0]]
    longer = features._totals(rows, "text", kind, (n[0] + 1, n[1]), (n[0], parts))
    assert longer.count() < sum(len(t.split(" ") if kind == "word" else t) > n[0] for t in tf) / 2


def test_language_of_a_text_in_blocks_of_profiles(spark, monkeypatch):
    """However many blocks the profiles come in, the sums of a text are the same."""
    rows = [(i, "ab ba ab" if i % 2 else "xy yx xy", "one" if i % 2 else "two") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = features.fit_language_profiles(df, "text", "lang")
    whole = {r["doc_id"]: (r["language"], round(r["confidence"], 9)) for r in features.detect_language(df, "doc_id", "text", profiles).collect()}
    monkeypatch.setattr(features, "PROFILE_ROWS", 10)
    assert whole == {r["doc_id"]: (r["language"], round(r["confidence"], 9)) for r in features.detect_language(df, "doc_id", "text", profiles).collect()}
    assert {i: v[0] for i, v in whole.items()} == {i: lang for i, _, lang in rows}
