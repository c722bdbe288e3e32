"""Fingerprints against a plain version window by window, and what they say of copies, edits and odd texts."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

import brute
from penprint.llm import digests, edits
from penprint.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_entropies_and_picks():
    rng = random.Random(2)
    for size in (0, 5, 63, 64, 65, 200, 3000):
        data = bytes(rng.choices(b"aaab c\x00\xff", k=size))
        want = [brute.entropy_bin(data[i:i + 64]) for i in range(len(data) - 63)]
        assert digests.entropy_bins(np.frombuffer(data, np.uint8)).tolist() == want
        for i in range(0, len(want), 50):
            exact = -sum(c / 64 * math.log2(c / 64) for c in Counter(data[i:i + 64]).values())
            assert abs(64 * exact - want[i]) < 1.01
        ranks = [rng.choice([0, 1, 5, 9, 65535]) for _ in range(size)]
        assert digests.picked(np.array(ranks, np.uint16)).tolist() == brute.picked(ranks)


def test_long_texts_are_looked_at_in_chunks(monkeypatch):
    monkeypatch.setattr(digests, "CHUNK", 100)
    data = bytes(random.Random(3).choices(b"abcdefgh ", k=1500))
    bins = digests.entropy_bins(np.frombuffer(data, np.uint8))
    assert bins.tolist() == [brute.entropy_bin(data[i:i + 64]) for i in range(len(data) - 63)]
    assert digests.picked(bins).tolist() == brute.picked(bins.tolist())


def plain(rows):
    """Rows of the query: sorted by id, each with the one after it."""
    rows = sorted(rows, key=lambda r: -r[0])
    ranks = brute.rarity([(t or "").encode() for _, t in rows])
    out = []
    for i, (name, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        changed = text[:len(text) - cut] + following[:cut]
        own, new, other = (brute.chain(t.encode(), ranks) for t in (text, changed, following))
        out.append((name, len(text), hashlib.sha256(changed.encode()).hexdigest(), base64.b64encode(own).decode(), base64.b64encode(new).decode(),
                    brute.likeness(own, new), brute.likeness(own, other)))
    return out


def agree(got, want):
    got, want = sorted(map(tuple, got)), sorted(want)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], abs=1e-6)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op13_fingerprints"](spark, FOLDER).collect()
    agree(got, plain(rows))
    assert sum(r.near_edited > r.near_next for r in got) >= 0.97 * len(got)


ODD = [(1, None), (2, ""), (3, "a"), (4, "ab"), (5, "é" * 50), (6, "word " * 30), (7, "word " * 30), (8, " " * 5000), (9, "x" * 64), (10, "lang " * 2 + "ß€𝄞" * 100),
       (30, "".join(chr(33 + i * i % 90) for i in range(3000)))]


def test_odd_texts(spark, monkeypatch):
    rng = random.Random(6)
    rows = ODD + [(100 + i, "".join(rng.choices("abcdefghij ", k=rng.randrange(2000)))) for i in range(60)] + [(500, "long words " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS fingerprint", "1 AS range")
    rarity = digests.fit_rarity(df)
    monkeypatch.setattr(edits, "BLOCK", 700)
    agree(edits.compare_edits(df, rarity).collect(), plain(rows))
    alone = digests.fingerprints(df, rarity, carry=["doc_id", "range"]).collect()
    assert {(r.doc_id, r.fingerprint) for r in alone} == {(r[0], r[3]) for r in plain(rows)}
    assert digests.fingerprints(df, rarity).columns == ["doc_id", "text", "range", "fingerprint"]


def test_repeated_and_null_ids(spark):
    rows = [(5, "one text of some length"), (5, "one text of some length"), (5, "another"), (None, "without an id"), (None, None), (1, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = edits.compare_edits(df, digests.fit_rarity(df)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    single = spark.createDataFrame([(1, "follows itself " * 40)], "doc_id long, text string")
    row = edits.compare_edits(single, digests.fit_rarity(single)).first()
    assert row.near_next == 1.0 and row.n_chars == 600
    none = df.limit(0)
    assert edits.compare_edits(none, digests.fit_rarity(none)).count() == digests.fingerprints(none, digests.fit_rarity(none)).count() == 0


def test_likeness():
    rng = random.Random(9)
    one, two = ("".join(rng.choices("abcdefghijklm ", k=40_000)).encode() for _ in range(2))
    rarity = digests.Rarity(np.arange(digests.BINS, dtype=np.uint16))
    half = one[:20_000] + two[20_000:]
    a, b, c, d = digests.digests_of([one, two, half, b""], rarity)
    assert digests.likeness(a, a) == 1.0 and digests.likeness(a, b) < 0.06 and 0.4 < digests.likeness(a, c) < 0.6
    assert digests.likeness(a, c) == digests.likeness(c, a) and digests.likeness(a, d) == 0.0 and digests.likeness(d, d) == 1.0
